"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Register a function of (spark, sf_dir), with DuckDB SQL for the same rows where SQL can say it.

    ``rounded`` columns are floating sums whose last bits depend on the order of
    addition; both sides give them to six digits.
    """
    if sql and rounded:
        sql = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounded)}) FROM ({sql})"

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.round(c, 6) for c in rounded})) if rounded else f
        if sql:
            ORACLES[name] = sql
        return f

    return add
