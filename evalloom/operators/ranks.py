"""Order statistics of groups of any size: ranks and percentiles from counts of values, without a window over a group.

A window by a few flags puts a table into a few tasks, and an exact percentile
merges all values in one. Here rows are counted by value first, which combines
before anything is exchanged. The distinct values are dealt by range, so a
group lies in as many partitions as its size asks for; a partition sums up its
own counts, and only one total for each partition and group is added up beside
them. A value's place in its group follows from both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.sources.session import joined_by, shuffle_partitions, written

#: Relative precision of the sketch that brackets a percentile: 1 / ACCURACY of the rows.
ACCURACY = 10_000


def value_places(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, before): each distinct value of a group, how many rows have it and how many have a smaller one.

    Null values are left out; NaN is the greatest value; a null in ``by`` is a
    group like others. ``rows`` may have counts already, in a column ``n``.
    """
    weight = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(weight.alias("n"))
    # the partition of a row has to be the same for totals and places, so it is written
    order = [*by, value]
    dealt = written(counts.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part", *by).agg(F.sum("n").alias("_n")).select("_part", *by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return joined_by(local, starts, ["_part", *by]).select(*by, value, "n", (F.col("_start") + F.col("_local")).alias("before"))


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, rank): ranks from 1, equal values share the mean of theirs."""
    return value_places(rows, by, value).select(*by, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def exact_percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], accuracy: int = ACCURACY) -> DataFrame:
    """For each group linear-interpolated percentiles ``wanted`` (name: column and share), null where the column has no value.

    A mergeable sketch gives two values between which a percentile surely lies;
    a second pass counts what is below them and keeps what is between, some
    5 / ``accuracy`` of the rows and any ties, as counts of values. Their places
    give the exact value.
    """
    names, step = list(wanted), 1.0 / accuracy
    slim = rows.select(*by, *[c.cast("double").alias(f"_v{i}") for i, (c, _) in enumerate(wanted.values())])
    # bracketed by the sketch's values two and a half steps of its precision below and above
    marks = [[max(0.0, p - 2.5 * step), min(1.0, p + 2.5 * step)] for _, p in wanted.values()]
    sketch = written(slim.groupBy(*by).agg(*[F.percentile_approx(f"_v{i}", m, accuracy).alias(f"_m{i}") for i, m in enumerate(marks)], *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(names))]))
    both = joined_by(slim, sketch.drop(*[f"_n{i}" for i in range(len(names))]), by)
    parts = []
    for i in range(len(names)):
        v, low, high = F.col(f"_v{i}"), F.col(f"_m{i}")[0], F.col(f"_m{i}")[1]
        side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
        parts.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("which"), side.alias("side"), F.when(side == 0, v).alias("value"), v.alias("v"))))
    each, keys = both.select(*by, F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull()))), [*by, "which"]
    counts = written(each.groupBy(*keys, "side", "value").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    inside = counts.filter("side = 0").select(*keys, "value", "n")
    below = counts.filter("side < 0").select(*keys, F.col("n").alias("_below"), "high")
    start = F.coalesce("_below", F.lit(0))
    places = joined_by(value_places(inside, keys, "value"), below.drop("high"), keys, "left").select(*keys, "value", "n", (F.col("before") + start).alias("before"))
    # of few rows the neighbours of what is between are asked for as well
    middle = inside.groupBy(*keys).agg(F.sum("n").alias("_inside"))
    above = joined_by(joined_by(counts.filter("side > 0").select(*keys, F.col("low").alias("value")), below.drop("high"), keys, "left"), middle, keys, "left")
    places = places.unionByName(below.select(*keys, F.col("high").alias("value"), F.lit(1).alias("n"), (F.col("_below") - 1).alias("before")))
    places = places.unionByName(above.select(*keys, "value", F.lit(1).alias("n"), (start + F.coalesce("_inside", F.lit(0))).alias("before")))
    at = [(F.col(f"_n{i}") - 1) * F.lit(float(p)) for i, (_, p) in enumerate(wanted.values())]
    sought = sketch.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("which"), F.floor(x).alias("k"), (x - F.floor(x)).alias("part")) for i, x in enumerate(at)])))
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
    found = joined_by(places, sought, keys).groupBy(*keys).agg(holds(F.col("k")).alias("_x"), holds(F.col("k") + (F.col("part") > 0).cast("int")).alias("_y"), F.first("part").alias("_p"))
    value = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_p"))
    wide = found.withColumn("_z", value).groupBy(*by).agg(*[F.max(F.when(F.col("which") == i, F.col("_z"))).alias(n) for i, n in enumerate(names)])
    return joined_by(sketch.select(*by), wide, by, "left") if by else wide
