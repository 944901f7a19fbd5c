"""Answer streams, the ingestion queue, rate limits and debounced work as folds over events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.sources.session import python_ready

ORDER = ("meta", "routing", "sources", "delta", "citations", "usage", "done")
ENDS = ("done", "error", "stopped")


def answers(frames: DataFrame, key: str) -> DataFrame:
    """(key, status, answer, n_deltas, in_order) of answer streams: rows (key, seq, event, data) in any order.

    The deltas before the first end make the answer, which a stop or an error
    keeps as far as it came; frames after the end do not count, and a stream
    without an end is open. in_order: no frame before the end comes after one of a
    later kind.
    """
    end = F.min(F.when(F.col("event").isin(*ENDS), F.col("seq"))).over(Window.partitionBy(key))
    rows = frames.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    place = F.coalesce(*[F.when(F.col("event") == e, F.lit(i)) for i, e in enumerate(ORDER)], F.lit(len(ORDER)))
    before = F.max(place).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_ok", F.coalesce(before <= place, F.lit(True)))
    said = F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", "data"))))
    status = F.max(F.when(F.col("seq") == F.col("_end"), F.col("event")))
    out = rows.groupBy(key).agg(F.coalesce(status, F.lit("open")).alias("status"), said.alias("_d"), F.bool_and("_ok").alias("in_order"))
    return out.select(key, "status", F.array_join(F.transform("_d", lambda d: d["data"]), "").alias("answer"), F.size("_d").alias("n_deltas"), "in_order")


def ingestion_claims(jobs: DataFrame, now: Column, org: str | None = None, lost_minutes: int = 15, most_attempts: int = 3) -> DataFrame:
    """(id, org_id, attempts, action, pos): the jobs that a worker may take, oldest first.

    Queued ones, and running ones whose lock is older than ``lost_minutes``. A job
    that has been tried ``most_attempts`` times is to fail instead of being claimed.
    """
    lost = (F.col("status") == "running") & (F.col("locked_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lost_minutes)))
    rows = jobs.filter((F.col("status") == "queued") | lost)
    rows = rows if org is None else rows.filter(F.col("org_id") == org)
    spent = F.col("attempts") >= most_attempts
    rows = rows.select("id", "org_id", F.when(spent, F.col("attempts")).otherwise(F.col("attempts") + 1).alias("attempts"), F.when(spent, "fail").otherwise("claim").alias("action"), "created_at")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("org_id").orderBy("created_at", "id"))).drop("created_at")


def token_bucket(requests: DataFrame, key: str, at: str, order: str, rate_per_minute: int) -> DataFrame:
    """(key, order, wait): seconds that each request waits for a token of its key's bucket, which refills evenly and holds a minute's worth.

    The bucket's level depends on every request before, so a key's requests are
    folded in order. Between full buckets the fold could be cut; a key's requests
    are taken as a client's log, which one task can hold.
    """
    python_ready(requests.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    cap = float(max(1, rate_per_minute))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, order])
        level, clock, waits = cap, None, []
        for t in pdf[at].astype("datetime64[us]").astype("int64") / 1e6:
            free = t if clock is None else max(t, clock)  # one waits behind the other
            level = cap if clock is None else min(cap, level + (free - clock) * cap / 60)
            pause = max(0.0, (1 - level) * 60 / cap)
            level = level + pause * cap / 60 - 1
            clock = free + pause
            waits.append(round(clock - t, 6))
        return pd.DataFrame({key: pdf[key], order: pdf[order], "wait": waits})

    return requests.select(key, order, at).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, wait double")


def debounced(events: DataFrame, key: str, at: str, seconds: int = 20) -> DataFrame:
    """(key, started, runs_at, n): one run for each burst, ``seconds`` after its first event; events until then join it.

    A run covers all events up to its time, so the next burst begins with the
    first event after it. Runs follow from each other, but events further apart
    than the delay always begin a new chain, so chains are cut there first and a
    chain's events are folded in SQL.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t")
    far = F.coalesce(F.col("_t") - F.lag("_t").over(w) > seconds * 1_000_000, F.lit(True))
    rows = events.select(key, t.alias("_t")).withColumn("_new", far.cast("int")).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chains = rows.groupBy(key, "_chain").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    step = seconds * 1_000_000
    open_ = F.struct(F.lit(None).cast("long").alias("s"), F.lit(0).alias("n"))
    none = F.array().cast("array<struct<s:bigint,n:int>>")

    def add(acc: Column, x: Column) -> Column:
        tail = F.coalesce(F.get(acc, F.size(acc) - 1), open_)
        joins = tail["s"].isNotNull() & (x <= tail["s"] + step)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(tail["s"].alias("s"), (tail["n"] + 1).alias("n"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("s"), F.lit(1).alias("n")))))

    runs = chains.select(key, F.explode(F.aggregate("_ts", none, add)).alias("r"))
    return runs.select(key, F.timestamp_micros("r.s").cast("timestamp_ntz").alias("started"), F.timestamp_micros(F.col("r.s") + step).cast("timestamp_ntz").alias("runs_at"), F.col("r.n").alias("n"))
