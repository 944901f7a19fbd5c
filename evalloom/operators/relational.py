"""Predicates, joins, windows, paging and set operations of the catalogue and log queries."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def optional(df: DataFrame, **equal) -> DataFrame:
    """Equality for each parameter that is not None; a list means any of its values."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def status_class(code: Column, wanted: str) -> Column:
    """"2xx" to "5xx" as a range, or an exact code; anything else is an error."""
    if len(wanted) == 3 and wanted[0] in "2345" and wanted[1:] == "xx":
        return code.between(int(wanted[0]) * 100, int(wanted[0]) * 100 + 99)
    return code == int(wanted)


def escaped_like(text: str) -> str:
    """The text as an ILIKE pattern that matches it anywhere, wildcards taken literally."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_any(text: str, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(escaped_like(text)), F.lit(False))
    return out


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the count of all rows; the count is one aggregate, not a window over everything."""
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def keyset_page(df: DataFrame, at: str, key: str, limit: int, before: tuple | None = None, after: tuple | None = None) -> DataFrame:
    """``limit`` + 1 rows, newest first, beyond a cursor (at, key); ``after`` pages back towards newer rows."""
    pair = F.struct(F.col(at), F.col(key))
    if after is not None:
        rows = df.filter(pair > F.struct(F.lit(after[0]).cast(df.schema[at].dataType), F.lit(after[1]).cast(df.schema[key].dataType)))
        return rows.orderBy(F.asc(at), F.asc(key)).limit(limit + 1).orderBy(F.desc(at), F.desc(key))
    if before is not None:
        df = df.filter(pair < F.struct(F.lit(before[0]).cast(df.schema[at].dataType), F.lit(before[1]).cast(df.schema[key].dataType)))
    return df.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)


def cursor(at, key) -> str:
    return base64.urlsafe_b64encode(json.dumps([str(at), key]).encode()).decode()


def read_cursor(text: str) -> tuple[str, object]:
    at, key = json.loads(base64.urlsafe_b64decode(text.encode()))
    return at, key


def as_of(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """The last value that is not null at or before each row."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def claim_order(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs that may be claimed: queued and due, or running with a lock older than five minutes; by priority, then age."""
    at = F.lit(now).cast("timestamp_ntz")
    due = (F.col("status") == "queued") & (F.col("available_at") <= at)
    lost = (F.col("status") == "running") & (F.col("locked_at") < at - F.expr("INTERVAL 5 MINUTES"))
    return jobs.filter(due | lost).orderBy(F.desc("priority"), "created_at", "id")


def backoff_seconds(attempt: Column) -> Column:
    """10 * 2^attempt, at most 300."""
    return F.least(10 * F.pow(F.lit(2), attempt), F.lit(300)).cast("int")


def pivot_export(rows: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row for each key with a text column for each name; what is missing or null is empty; of several values the largest counts."""
    wide = rows.groupBy(key).pivot(name, names).agg(F.max(value))
    return wide.select(key, *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names])
