"""Intervals, paired tests, agreement, aggregates by slice, sampling and allocation.

Closed forms are Column expressions; resampling stands in
:mod:`evalloom.operators.resampling`, ranks in :mod:`evalloom.operators.ranks`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.operators.ranks import average_ranks
from evalloom.operators.resampling import PAIRED_BOOTSTRAP, bootstrap_means, flip_tests
from evalloom.sources.session import joined_by, written

Z = 1.959963984540054
UNIT_EPSILON = RELATIVE_EPSILON = 0.1


def wilson(passed: Column, n: Column) -> tuple[Column, Column]:
    """Low and high end of the 95 % interval of a proportion; null for n = 0."""
    p = F.least(F.greatest(passed / n, F.lit(0.0)), F.lit(1.0))
    scale = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / scale
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / scale
    none = n == 0
    low, high = F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))
    return F.when(~none, low), F.when(~none, high)


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided McNemar p from the discordant counts, however many; 0 only where p is below the smallest double."""
    m, k = a_only + b_only, F.least(a_only, b_only).cast("int")
    # sum over i <= k of C(m, i) / 2^m: the logarithm of the largest term, i = k, and the others as parts of it
    log = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, i: s + F.log((m - i + 1) / (2.0 * i)))).otherwise(0.0) - (m - k) * math.log(2)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * i / (m - i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    parts = F.aggregate(F.sequence(k, F.lit(0)), start, step, lambda s: s["sum"])
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(log) * parts))


def agresti_min(a_only: Column, b_only: Column, n: Column) -> tuple[Column, Column]:
    """Interval of the difference b - a of paired proportions."""
    size = n + 2
    pb, pa = (b_only + 0.5) / size, (a_only + 0.5) / size
    d = pb - pa
    se = F.sqrt(F.greatest(F.lit(0.0), (pa + pb - d * d) / size))
    return F.greatest(d - Z * se, F.lit(-1.0)), F.least(d + Z * se, F.lit(1.0))


def holm(df: DataFrame, p: str, into: str = "p_holm", by: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p within each family; null passes through and does not count."""
    family = [F.col(c) for c in by or []]
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*family, known)
    order = w.orderBy(p, *[c for c in df.columns if c != p])
    scaled = F.col(p) * (F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1)
    df = df.withColumn("_scaled", scaled)
    return df.withColumn(into, F.when(known, F.least(F.lit(1.0), F.max("_scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))))).drop("_scaled")


def change_class(a: Column, b: Column, kind: str) -> Column:
    """improved, regressed or unchanged: a flip of a binary metric, more than 0.1 on a unit scale, else over 10 % of the larger magnitude."""
    if kind == "binary":
        moved = (a >= 0.5) != (b >= 0.5)
    elif kind == "unit":
        moved = F.abs(b - a) > UNIT_EPSILON
    else:
        moved = F.abs(b - a) > RELATIVE_EPSILON * F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), None).when(~moved, "unchanged").when(b > a, "improved").otherwise("regressed")


def paired_binary(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Counts, difference, McNemar p and Agresti-Min interval of paired binary scores."""
    x, y = F.col(a) >= 0.5, F.col(b) >= 0.5
    out = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(x & ~y).alias("a_only"), F.count_if(y & ~x).alias("b_only"))
    low, high = agresti_min(F.col("a_only"), F.col("b_only"), F.col("n"))
    return out.withColumns({"delta": (F.col("b_only") - F.col("a_only")) / F.col("n"), "p": mcnemar(F.col("a_only"), F.col("b_only")), "low": low, "high": high})


def paired_continuous(pairs: DataFrame, a: str, b: str, by: list[str], salt: str = "paired") -> DataFrame:
    """(by, n, delta, low, high, p): mean difference b - a with bootstrap interval and sign-flip p of each group; pairs with a null do not count."""
    rows = pairs.select(*by, (F.col(b) - F.col(a)).alias("_d"))
    means = bootstrap_means(rows, by, "_d", salt, PAIRED_BOOTSTRAP).withColumnRenamed("mean", "delta")
    return joined_by(means, flip_tests(rows, by, "_d", salt), by)


def slices(case: dict[str, Column]) -> Column:
    """Slice names of a case: all, and "name:value" for each scalar or array that is not null."""
    each = [F.array(F.lit("all"))]
    for name, value in case.items():
        each.append(F.when(value.isNotNull(), F.array(F.concat(F.lit(f"{name}:"), value.cast("string")))).otherwise(F.array().cast("array<string>")))
    return F.concat(*each)


def slice_aggregates(scores: DataFrame, slice_column: str, metric: str, value: str, status: str) -> DataFrame:
    """n, mean, Wilson interval of the values of 1, and counts of the statuses that are not averaged."""
    ok = F.col(status) == "ok"
    out = scores.groupBy(slice_column, metric).agg(
        F.count_if(ok).alias("n"), F.avg(F.when(ok, F.col(value))).alias("mean"), F.count_if(ok & (F.col(value) >= 0.5)).alias("passed"),
        F.count_if(F.col(status) == "na").alias("n_na"), F.count_if(F.col(status) == "error").alias("n_error"),
    )
    low, high = wilson(F.col("passed"), F.col("n"))
    return out.withColumns({"low": low, "high": high})


def confusion(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or []), a, b).agg(F.count(F.lit(1)).alias("n"))


def kappa(df: DataFrame, a: str, b: str, k: int, quadratic: bool = False, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of categories 0 to k - 1; null when empty or when chance explains all."""
    by = by or []
    cells = confusion(df, a, b, by)
    # marginals of a fixed number of categories: one row of sums for each family
    rows = [F.sum(F.when(F.col(a) == i, F.col("n")).otherwise(0)).alias(f"_a{i}") for i in range(k)]
    cols = [F.sum(F.when(F.col(b) == i, F.col("n")).otherwise(0)).alias(f"_b{i}") for i in range(k)]
    weight = lambda i, j: (i - j) ** 2 / (k - 1) ** 2 if quadratic else float(i != j)
    apart = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) / float((k - 1) ** 2) if quadratic else (F.col(a) != F.col(b)).cast("double")
    sums = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(apart * F.col("n")).alias("_o"), *rows, *cols)
    chance = sum((F.col(f"_a{i}") * F.col(f"_b{j}") * weight(i, j) for i in range(k) for j in range(k) if weight(i, j)), F.lit(0.0)) / F.col("n")
    value = F.when((F.col("n") > 0) & (chance > 1e-12), 1 - F.col("_o") / chance)
    return sums.select(*by, "n", value.alias("kappa"))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson correlation of average ranks within each group; null for a constant rater.

    Rows are counted by their pair of values first, and ranks come from counts
    of values, so no task has a group: see :mod:`evalloom.operators.ranks`.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = written(rows.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n")))
    sizes = pairs.groupBy(*by).agg(((F.sum("n") + 1) / 2).alias("_mid"))
    ranks = {c: average_ranks(pairs, by, c).select(*by, c, F.col("rank").alias(f"{c}r")) for c in ("_a", "_b")}
    both = joined_by(joined_by(joined_by(pairs, ranks["_a"], [*by, "_a"]), ranks["_b"], [*by, "_b"]), sizes, by)
    x, y, n = F.col("_ar") - F.col("_mid"), F.col("_br") - F.col("_mid"), F.col("n")  # ranks about their mean
    sums = both.groupBy(*by).agg(F.sum(n).alias("_n"), F.sum(n * x * y).alias("_xy"), F.sum(n * x * x).alias("_xx"), F.sum(n * y * y).alias("_yy"))
    return sums.select(*by, F.col("_n").alias("n"), F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"))


def agreement(df: DataFrame, judge: str, human: str, by: list[str]) -> DataFrame:
    """Exact and within-one share in percent, mean absolute error and bias (judge - human)."""
    d = F.col(judge) - F.col(human)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg((d == 0).cast("int"))).alias("exact"), (100 * F.avg((F.abs(d) <= 1).cast("int"))).alias("within1"),
        F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
    )


def calibration_status(n: Column, k: Column) -> Column:
    return F.when((n < 20) | k.isNull(), "uncalibrated").when(k < 0.4, "unreliable").when((k < 0.6) | (n < 30), "moderate").otherwise("calibrated")


def seeded(seed: int | str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """Round-robin over the strata, each in seeded order: the k-th of every stratum before any k + 1-th."""
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy(seeded(seed, key)))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= n).orderBy("_nth", *strata).limit(n).drop("_nth")


def random_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(seeded(seed, key), key).limit(n)


def allocate(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder allocation of ``total`` with at least one for each key of positive weight; needs total >= keys."""
    rows = weights.filter(F.col(weight) > 0).crossJoin(F.broadcast(weights.filter(F.col(weight) > 0).agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_k"))))
    share = (F.lit(total) - F.col("_k")) * F.col(weight) / F.col("_sum")
    rows = rows.withColumn("_floor", F.floor(share)).withColumn("_rest", share - F.floor(share))
    left = rows.agg((F.lit(total) - F.first("_k") - F.sum("_floor")).alias("_left"))
    nth = F.row_number().over(Window.orderBy(F.desc("_rest"), key))  # keys of an allocation are few
    return rows.crossJoin(F.broadcast(left)).withColumn("_nth", nth).select(key, (1 + F.col("_floor") + (F.col("_nth") <= F.col("_left")).cast("int")).cast("long").alias("n"))


def weighted_draw(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """Without replacement, by the keys -ln(u) / w of seeded uniform numbers."""
    u = (F.conv(F.substring(seeded(seed, key), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    return df.filter(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(n)


def disagreement(*gaps: Column) -> Column:
    return F.least(F.greatest(*gaps, F.lit(0.0)), F.lit(1.0))
