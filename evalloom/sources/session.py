"""Session helpers: the package on the executors, and partition counts."""

from __future__ import annotations

import functools
import pathlib
import re
import tempfile
import uuid
import zipfile

import evalloom
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def python_ready(spark: SparkSession, rows: int | None = None) -> None:
    """Before Python runs on executors: send them this package; ``rows`` keeps Arrow batches of long texts small."""
    if rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(evalloom.__file__).parent
    to = pathlib.Path(tempfile.mkdtemp(prefix="evalloom-ship-"), "evalloom.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_place(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a temporary one stands in for it in local mode alone."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="evalloom-")
    return f"{base}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: what is read twice is computed once, and a lost executor repeats its own part only.

    From then on an action's shuffle files go when it ends.
    """
    path = shared_place(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are values like others, the left side's keys kept; without keys the right side is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    names = [f"_right{i}" for i in range(len(keys))]
    other = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in right.columns if c not in keys])
    same = functools.reduce(lambda x, y: x & y, [left[k].eqNullSafe(other[n]) for k, n in zip(keys, names, strict=True)])
    return left.join(other, same, how).drop(*names)
