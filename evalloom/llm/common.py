"""What the corpus operators share: shared-folder checkpoints and text helpers."""

from __future__ import annotations

import re
import tempfile

from evalloom.sources.session import python_ready as _ready
from evalloom.sources.session import shuffle_partitions as shuffle_partitions
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words and the characters stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, for checkpoints and written tables.

    Only where neither the context nor the session names one and the master is
    local (tests on one machine) a temporary folder stands in for it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evalloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; the files go when the frame is no longer used, if the session cleans them."""
    spark = df.sparkSession
    shared_folder(spark)
    drop_shuffles(spark)
    return df.checkpoint(eager=True)


def drop_shuffles(spark: SparkSession) -> None:
    """From now on an action's shuffle files go when it ends; what is used again has been written to the shared folder."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def python_ready(spark: SparkSession, rows: int = 256) -> None:
    """The package on the executors, and Arrow batches of at most ``rows`` texts."""
    _ready(spark, rows)


def public(df: DataFrame) -> DataFrame:
    """Without columns that begin with an underscore: those names are the operators' own, and such columns are not kept."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal expression, so that no Python or RDD takes part in reading it."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
