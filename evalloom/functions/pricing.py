"""Token prices in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(14,8)"


def tier_alias(tier: Column) -> Column:
    """null, standard and default are one tier; other names are looked up as they are."""
    return F.when(tier.isNull() | tier.isin("default", "standard"), "standard").otherwise(tier)


def priced(calls: DataFrame, book: DataFrame) -> DataFrame:
    """``calls`` with cost (8 places) and estimated.

    ``book`` has model, tier, input, cached and output rates per million tokens.
    Cached tokens count up to the input. A tier that the model lacks falls back
    to its standard rates and an unknown model costs 0; both are estimates. The
    book is a small table that Catalyst broadcasts by its size.
    """
    rates = book.select(F.col("model").alias("_m"), F.col("tier").alias("_t"), *[F.col(c).cast("decimal(12,6)").alias(f"_{c}") for c in ("input", "cached", "output")])
    base = rates.filter("_t = 'standard'").select(F.col("_m").alias("_m0"), *[F.col(f"_{c}").alias(f"_{c}0") for c in ("input", "cached", "output")])
    tier = tier_alias(F.col("tier"))
    rows = calls.withColumn("_tier", tier).join(rates, (F.col("model") == F.col("_m")) & (F.col("_tier") == F.col("_t")), "left").join(base, F.col("model") == F.col("_m0"), "left")
    rate = {c: F.coalesce(f"_{c}", f"_{c}0", F.lit(0)).cast("decimal(12,6)") for c in ("input", "cached", "output")}
    hit = F.least("cached_tokens", "input_tokens")
    tokens = lambda c: c.cast("decimal(18,0)")
    cost = tokens(F.col("input_tokens") - hit) * rate["input"] + tokens(hit) * rate["cached"] + tokens(F.col("output_tokens")) * rate["output"]
    return rows.select(*calls.columns, (cost / F.lit(1_000_000)).cast(MONEY).alias("cost"), F.col("_t").isNull().alias("estimated"))


def longest_prefix(calls: DataFrame, models: DataFrame) -> DataFrame:
    """The known model whose name is the longest prefix of each call's model, or null; both sides by distinct names."""
    names = calls.select("model").distinct()
    hits = names.join(models.select(F.col("model").alias("known")), F.expr("startswith(model, known)"), "left")
    best = hits.groupBy("model").agg(F.max_by("known", F.length("known")).alias("known"))
    return calls.join(best, "model", "left")
