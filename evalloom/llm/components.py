"""Connected components of links that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has a link with the smallest node of its component, but for the roots.

    Large-star and small-star steps in turn: every node's larger neighbours,
    then its smaller ones, are linked with the smallest node it knows. Both are
    an aggregate with map-side combination and a join, and the number of rounds
    grows with the logarithm of a component. Null, repeated and self links are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges = checkpointed(edges)
    while True:
        # both directions by an explode: a union of a checkpoint with itself loses track of the checkpoint's constraints
        both = _each(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _each(large.join(least, "u"), ("v", "m"), ("u", "m"))
        edges = checkpointed(small.filter("u <> v").distinct())
        if _stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) for each pair of columns of each row."""
    return df.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("_e")).select("_e.u", "_e.v")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v only and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    sums = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.in").alias("in"))
    return sums.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()
