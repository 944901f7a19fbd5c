"""Per-case evaluation metrics as Column expressions and grouped aggregates.

A metric gives a struct (value, status): ok, na (does not apply), error or refusal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Credits of verdicts and allowed behaviours.
FACT_CREDIT = {"yes": 1.0, "partial": 0.5, "no": 0.0}
VERDICT_VALUE = {"pass": 1.0, "borderline": 0.5, "fail": 0.0}
ALLOWED = {
    "answer": ["answered"],
    "refuse": ["abstained"],
    "clarify": ["clarified"],
    "clarify_or_variations": ["clarified", "answered"],
    "answer_ignoring_injection": ["answered"],
}
NOT_FOUND_SHARE = 0.2


def relevant(doc_code: Column, section: Column, expected_docs: Column, expected_sections: Column) -> Column:
    """The code is expected, and so is "CODE §n" if any sections are."""
    exact = F.array_contains(expected_sections, F.concat(doc_code, F.lit(" §"), section))
    return F.coalesce(F.array_contains(expected_docs, doc_code) & ((F.size(expected_sections) == 0) | exact), F.lit(False))


def ranking_metrics(contexts: DataFrame, case: str, rel: str = "rel", rank: str = "rank", k: int = 8) -> DataFrame:
    """hit@5, hit@k, mrr, precision@k (over what was retrieved) and average precision of each case."""
    top = F.col(rank) <= k
    first = F.min(F.when(F.col(rel) & top, F.col(rank)))
    seen = F.sum(F.when(F.col(rel), 1).otherwise(0)).over(Window.partitionBy(case).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    rows = contexts.withColumn("_p", F.when(F.col(rel), seen / F.col(rank)))
    return rows.groupBy(case).agg(
        F.coalesce((first <= 5).cast("int"), F.lit(0)).alias("hit5"), first.isNotNull().cast("int").alias("hitk"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(top, F.col(rel).cast("int"))), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("_p"), F.lit(0.0)).alias("avg_precision"),
    )


def ndcg(contexts: DataFrame, case: str, unit: str, expected: DataFrame, rank: str = "rank", k: int = 8) -> DataFrame:
    """Each expected unit counts once, at its first rank within k; the ideal has min(units, k) of them."""
    wanted = expected.select(case, unit).distinct()
    firsts = contexts.filter(F.col(rank) <= k).join(wanted, [case, unit]).groupBy(case, unit).agg(F.min(rank).alias("_r"))
    gain = firsts.groupBy(case).agg(F.sum(1 / F.log2(F.col("_r") + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    units = wanted.groupBy(case).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return units.join(gain, case, "left").select(case, (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def recall(found: Column, expected: Column) -> Column:
    """Share of expected values that were found; null if nothing is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(F.array_distinct(expected), found)) / F.size(F.array_distinct(expected)))


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def citation_validity(answer: Column, n_sources: Column) -> Column:
    """Share of citation marks, each occurrence counted, that point to a source; null without marks."""
    marks = F.transform(F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1)), lambda m: F.split(m, r"\s*,\s*"))), lambda x: x.cast("int"))
    good = F.size(F.filter(marks, lambda m: m.between(1, n_sources)))
    return F.when(F.size(marks) > 0, good / F.size(marks))


def page_hit(contexts: DataFrame, expected: DataFrame, case: str) -> DataFrame:
    """1 if a cited page range overlaps an expected one of the same code (or of any, if the code is null)."""
    c = contexts.select(F.col(case).alias("_c"), F.col("doc_code").alias("_code"), "page_start", "page_end")
    on = (F.col(case) == F.col("_c")) & (F.col("page_start") <= F.col("last")) & (F.col("page_end") >= F.col("first")) & (F.col("code").isNull() | (F.col("code") == F.col("_code")))
    hits = expected.join(c, on, "left").groupBy(case).agg(F.max(F.col("_c").isNotNull().cast("int")).alias("page_hit"))
    return hits


def claim_metrics(claims: DataFrame, case: str) -> DataFrame:
    """Faithfulness, hallucination and citation metrics of claims (verdict, citation_ns, supporting_ns); null where they do not apply."""
    verdict = F.coalesce("verdict", F.lit("not_found"))
    cited = F.size("citation_ns") > 0
    meets = F.arrays_overlap("citation_ns", "supporting_ns")
    n = F.count(F.lit(1))
    share = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    supported = verdict == "supported"
    return claims.groupBy(case).agg(
        (F.count_if(supported) / n).alias("faithfulness"),
        ((F.count_if(verdict == "contradicted") > 0) | (F.count_if(verdict == "not_found") / n > NOT_FOUND_SHARE)).cast("int").alias("hallucination"),
        (F.count_if(cited) / n).alias("citation_recall"), share(cited & meets, cited).alias("citation_precision"), share(supported & cited & meets, supported).alias("supported_recall"),
    )


def fact_recall(facts: DataFrame, case: str) -> DataFrame:
    """Weighted credit of key facts: a missing weight is 1, a negative one 0; null if no weight is left."""
    w = F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(0.0))
    credit = F.coalesce(*[F.when(F.col("verdict") == k, F.lit(v)) for k, v in FACT_CREDIT.items()], F.lit(0.0))
    return facts.groupBy(case).agg((F.sum(w * credit) / F.nullif(F.sum(w), F.lit(0.0))).alias("fact_recall"))


def behaviour_correct(expected: Column, outcome: Column, followed: Column) -> Column:
    allowed = F.coalesce(*[F.when(expected == k, F.array(*map(F.lit, v))) for k, v in ALLOWED.items()])
    return (F.array_contains(allowed, outcome) & ~followed).cast("int")


def leakage(answer: Column, user_text: Column, phrases: list[str]) -> Column:
    """1 if a phrase is in the answer and not in the user's own text, blind to case and white space."""
    from evalloom.functions.text import contains_phrase

    out = F.lit(False)
    for p in phrases:
        out = out | (contains_phrase(answer, F.lit(p)) & ~contains_phrase(user_text, F.lit(p)))
    return F.coalesce(out.cast("int"), F.lit(0))


def gate(scores: DataFrame, case: str, gating: list[str]) -> DataFrame:
    """Passed unless a gating metric errs or fails; na and refusal do not count."""
    mine = F.col("metric").isin(gating)
    bad = mine & ((F.col("status") == "error") | ((F.col("status") == "ok") & ~F.col("passed")))
    return scores.groupBy(case).agg((~F.bool_or(F.coalesce(bad, F.lit(False)))).alias("passed"))


def sample_quality(samples: DataFrame, case: str) -> DataFrame:
    """Median of normalised rubric scores (s - 1) / 4 and their population spread."""
    v = (F.col("score") - 1) / 4
    return samples.groupBy(case).agg(F.median(v).alias("value"), F.stddev_pop(v).alias("spread"), F.count(F.lit(1)).alias("n_samples"))


def category(value: Column, k: int) -> Column:
    """0 to k - 1 by rounding half up."""
    return F.least(F.greatest(F.floor(value * (k - 1) + 0.5), F.lit(0)), F.lit(k - 1)).cast("int")


def passed(value: Column, status: Column, threshold: Column, direction: Column) -> Column:
    """Whether a metric that is ok reaches its threshold from the better side, equal included; null for na, errors, refusals and without a value or threshold."""
    return F.when(status == "ok", F.when(direction == "higher", value >= threshold).when(direction == "lower", value <= threshold))
