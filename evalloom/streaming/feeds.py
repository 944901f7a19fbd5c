"""Structured Streaming over files: counters, feeds, folds and event-time windows.

The driver tables have timestamps without zone; streams cast them, because a
watermark needs an instant.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalloom.sources.session import python_ready, shared_place


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """Files of a folder as a stream, ``files`` for each trigger, ts as an instant."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def large_state(spark: SparkSession):
    """State on disk, as stateful processors need it, for streams that start inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def drained(stream: DataFrame, mode: str = "complete", place: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result table.

    complete replaces the table in every batch; update and append add to it. A
    ``place`` that a run has used before goes on after that run's last batch.
    """
    spark = stream.sparkSession
    place = place or shared_place(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={0 if mode == 'complete' else number}")

    with large_state(spark):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out").select(*stream.columns)


def monthly_counters(events: DataFrame) -> DataFrame:
    """Messages and tokens of each user and month; deletes never refund, evaluation traffic does not count."""
    own = events.filter(F.col("event_id") % 7 != 0)
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return own.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("messages"), F.sum(tokens).alias("tokens"))


def quota_status(counters: DataFrame, limits: DataFrame, messages: int = 25, tokens: int = 200_000) -> DataFrame:
    """Custom or default limits; messages are checked before tokens, used >= limit exhausts, admins never are."""
    rows = counters.join(limits.select("user_id", F.col("message_limit").alias("_ml"), F.col("token_limit").alias("_tl"), "is_admin"), "user_id", "left")
    ml, tl = F.coalesce("_ml", F.lit(messages)), F.coalesce("_tl", F.lit(tokens))
    spent = F.when(F.coalesce("is_admin", F.lit(False)), None).when(F.col("messages") >= ml, "messages").when(F.col("tokens") >= tl, "tokens")
    return rows.select("user_id", "month", ml.alias("message_limit"), tl.alias("token_limit"), spent.alias("exhausted"))


def changes_after(rows: DataFrame, at: str, key: str, cursor: tuple[str, object], most: int = 50) -> DataFrame:
    """The next changes of a resumable feed: beyond the cursor in order of (at, key), so many at most."""
    kind = rows.schema
    beyond = F.struct(F.col(at), F.col(key)) > F.struct(F.lit(cursor[0]).cast(kind[at].dataType), F.lit(cursor[1]).cast(kind[key].dataType))
    return rows.filter(beyond).orderBy(at, key).limit(most)


def quest_fold(events: DataFrame, need: int = 3) -> DataFrame:
    """Batch form of the quest state: kinds seen, and when the ``need``-th distinct kind came (null before)."""
    firsts = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("at"))
    times = F.array_sort(F.collect_list("at"))
    return firsts.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("progress"), times.alias("_t")).select("user_id", "progress", F.get("_t", F.lit(need - 1)).alias("done_at"))


def quest_stream(events: DataFrame, need: int = 3) -> DataFrame:
    """The same as a stateful stream: progress only grows, a replayed event changes nothing."""
    python_ready(events.sparkSession)

    def fold(key, batches, state: GroupState):
        firsts: dict[str, pd.Timestamp] = dict(zip(*state.get, strict=True)) if state.exists else {}
        for b in batches:
            for kind, at in zip(b["event_type"], b["ts"], strict=True):
                if kind not in firsts or at < firsts[kind]:
                    firsts[kind] = at
        kinds = sorted(firsts)
        state.update((kinds, [firsts[k].to_pydatetime() for k in kinds]))
        times = sorted(firsts.values())
        yield pd.DataFrame({"user_id": [key[0]], "progress": pd.array([len(times)], "int32"), "done_at": [times[need - 1] if len(times) >= need else pd.NaT]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, progress int, done_at timestamp", "kinds array<string>, firsts array<timestamp>", "update", GroupStateTimeout.NoTimeout)


def merged_state(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable states: the larger progress, the first time, the union of cards."""
    return a.unionByName(b).groupBy(*keys).agg(F.max("progress").alias("progress"), F.min("done_at").alias("done_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cards")))).alias("cards"))


def tumbling(events: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    """An addition: counts and sums by event-time window, late rows dropped behind the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    rows = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """An addition: sessions of each user that end after a gap."""
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Idempotent delivery: a repeated key within the watermark is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_state(status: Column, total: Column, finished: Column, in_flight: Column) -> Column:
    """The next state of a run from its counters: stopping settles when nothing is in flight, running finalizes when all is finished."""
    return F.when((status == "stopping") & (in_flight == 0), "finalizing").when((status == "pausing") & (in_flight == 0), "paused").when((status == "running") & (finished >= total), "finalizing").otherwise(status)
