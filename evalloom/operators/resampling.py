"""Bootstrap intervals and sign-flip tests of groups of any size.

A resample of n values with replacement is a multinomial draw over their
distinct values, and n random signs of equal differences are a binomial draw.
So values are counted first, a group's distinct values are dealt into blocks by
their hash, and a task draws all rounds of one block: first the blocks' totals
are drawn, then each block's values within its total. Rounds are summed over
blocks. Seeds depend on the salt, the group and the block alone, so a draw is
the same on any number of partitions and when a lost task is run again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.sources.session import joined_by, python_ready, written

BOOTSTRAP, PAIRED_BOOTSTRAP, PERMUTATIONS, EXACT_MAX = 2000, 5000, 10_000, 16
#: Distinct values of a block, about, and rounds that are drawn at once.
BLOCK_VALUES, ROUNDS = 4096, 100


def seed_of(*parts: str) -> int:
    """First eight bytes of the sha256 of the parts joined by the unit separator."""
    return int.from_bytes(hashlib.sha256("\x1f".join(parts).encode()).digest()[:8], "big")


def resampled_sums(values: np.ndarray, counts: np.ndarray, totals: np.ndarray, seed: int) -> np.ndarray:
    """For each round the sum of ``totals[round]`` values drawn with replacement, each value as likely as its count says."""
    rng, out = np.random.default_rng(seed), []
    for k in range(0, len(totals), ROUNDS):
        out.append(rng.multinomial(totals[k : k + ROUNDS], counts / counts.sum()) @ values)
    return np.concatenate(out)


def signed_sums(values: np.ndarray, counts: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """For each round the sum of all values, each with a random sign."""
    rng, out = np.random.default_rng(seed), []
    for k in range(0, rounds, ROUNDS):
        up = rng.binomial(counts, 0.5, (min(ROUNDS, rounds - k), len(counts)))
        out.append((2 * up - counts) @ values)
    return np.concatenate(out)


def exact_flip(differences: np.ndarray) -> float:
    """Two-sided sign-flip p of a few differences that are not zero, by all their signs."""
    seen, tolerance = abs(differences.sum()), 1e-9 * max(1.0, np.abs(differences).sum())
    signs = 1 - 2 * ((np.arange(1 << len(differences))[:, None] >> np.arange(len(differences))) & 1)
    return float((np.abs(signs @ differences) >= seen - tolerance).mean())


def _blocks(df: DataFrame, groups: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(groups, _v, _n, _block) of the distinct values, and (groups, n, _distinct, _sum, _only) of all groups, those without a value included."""
    counts = df.groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col("_v").isNotNull()
    counts = written(counts)
    sizes = counts.groupBy(*groups).agg(F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("n"), F.count("_v").alias("_distinct"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"), F.min("_v").alias("_only"))
    rows = joined_by(counts.filter(known), sizes.select(*groups, F.ceil(F.col("_distinct") / BLOCK_VALUES).alias("_blocks")), groups)
    return rows.select(*groups, "_v", "_n", F.pmod(F.xxhash64("_v"), F.col("_blocks")).alias("_block")), sizes


def _named(df: DataFrame, groups: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(g).cast("string"), F.lit("None")) for g in groups])


def _kinds(df: DataFrame, groups: list[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema if f.name in groups)


def bootstrap_means(df: DataFrame, groups: list[str], value: str, salt: str, rounds: int = BOOTSTRAP) -> DataFrame:
    """(groups, n, mean, low, high): mean and 95 % percentile bootstrap interval of each group; nulls are left out.

    One value or equal values give themselves, a group without a value nulls.
    """
    python_ready(df.sparkSession)
    rows, sizes = _blocks(df, groups, value)
    rows = written(rows.withColumn("_name", _named(df, groups)))
    schema = _kinds(df, groups)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        n = pdf["_t"].to_numpy(np.int64)
        rng = np.random.default_rng(seed_of(salt, *pdf["_name"].iloc[0], "blocks"))
        drawn = rng.multinomial(n.sum(), n / n.sum(), rounds) if len(n) > 1 else np.full((rounds, 1), n.sum())
        return pdf[[*groups, "_block"]].assign(_drawn=[drawn[:, k] for k in range(len(n))])

    def sums(values: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if not len(values) or not len(drawn):
            return pd.DataFrame({c: [] for c in [*groups, "_round", "_s"]})
        values = values.sort_values("_v")
        seed = seed_of(salt, *values["_name"].iloc[0], "block", str(values["_block"].iloc[0]))
        made = resampled_sums(values["_v"].to_numpy(float), values["_n"].to_numpy(np.int64), np.asarray(drawn["_drawn"].iloc[0], np.int64), seed)
        return pd.DataFrame({**{g: [values[g].iloc[0]] * rounds for g in groups}, "_round": range(rounds), "_s": made})

    keys = [*groups, "_block"]
    per_block = rows.groupBy(*keys, "_name").agg(F.sum("_n").alias("_t"))
    drawn = per_block.groupBy(*groups).applyInPandas(totals, f"{schema}_block long, _drawn array<long>")
    each = rows.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInPandas(sums, f"{schema}_round int, _s double")
    means = joined_by(each.groupBy(*groups, "_round").agg(F.sum("_s").alias("_s")), sizes.select(*groups, "n"), groups).withColumn("_m", F.round(F.col("_s") / F.col("n"), 12))
    ends = means.groupBy(*groups).agg(F.percentile("_m", 0.025).alias("_low"), F.percentile("_m", 0.975).alias("_high"))  # of ``rounds`` values
    same = F.col("_distinct") == 1
    out = joined_by(sizes, ends, groups, "left")
    return out.select(*groups, "n", F.when(same, F.col("_only")).otherwise(F.col("_sum") / F.nullif(F.col("n"), F.lit(0))).alias("mean"), F.when(same, F.col("_only")).otherwise(F.col("_low")).alias("low"), F.when(same, F.col("_only")).otherwise(F.col("_high")).alias("high"))


def flip_tests(df: DataFrame, groups: list[str], value: str, salt: str, rounds: int = PERMUTATIONS) -> DataFrame:
    """(groups, p): two-sided sign-flip p of each group's differences.

    Exact where at most ``EXACT_MAX`` differences are not zero, 1 where none is,
    else by ``rounds`` random signs with the +1 rule.
    """
    python_ready(df.sparkSession)
    rows, sizes = _blocks(df.withColumn("_d", F.nullif(F.col(value).cast("double"), F.lit(0.0))), groups, "_d")
    rows = written(joined_by(rows.withColumn("_name", _named(df, groups)), sizes.select(*groups, F.col("n").alias("_size")), groups))
    schema = _kinds(df, groups)

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_v")
        return pdf[groups].head(1).assign(p=exact_flip(np.repeat(pdf["_v"].to_numpy(float), pdf["_n"].to_numpy(np.int64))))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_v")
        made = signed_sums(pdf["_v"].to_numpy(float), pdf["_n"].to_numpy(np.int64), rounds, seed_of(salt, *pdf["_name"].iloc[0], "flip", str(pdf["_block"].iloc[0])))
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * rounds for g in groups}, "_round": range(rounds), "_s": made})

    few = rows.filter(F.col("_size") <= EXACT_MAX).groupBy(*groups).applyInPandas(exact, f"{schema}p double")
    each = rows.filter(F.col("_size") > EXACT_MAX).groupBy(*groups, "_block").applyInPandas(sums, f"{schema}_round int, _s double")
    seen = rows.groupBy(*groups).agg(F.abs(F.sum(F.col("_v") * F.col("_n"))).alias("_seen"), (F.greatest(F.lit(1.0), F.sum(F.abs("_v") * F.col("_n"))) * 1e-9).alias("_near"))
    hits = joined_by(each.groupBy(*groups, "_round").agg(F.abs(F.sum("_s")).alias("_s")), seen, groups)
    many = hits.groupBy(*groups).agg(((F.count_if(F.col("_s") >= F.col("_seen") - F.col("_near")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return joined_by(sizes.select(*groups), few.unionByName(many), groups, "left").select(*groups, F.coalesce("p", F.lit(1.0)).alias("p"))
