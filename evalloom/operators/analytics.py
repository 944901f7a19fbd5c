"""Usage and quality analytics: filtered aggregates, exact percentiles, gap-filled series, explodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.ranks import exact_percentiles


def answered() -> Column:
    return (F.col("operation") == "answer") & (F.col("status") == "ok")


def scoped(df: DataFrame, start=None, end=None, org_id=None, at: str = "created_at") -> DataFrame:
    """Rows of [start, end) and of one organisation; a parameter that is None filters nothing (and builds no predicate)."""
    if start is not None:
        df = df.filter(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(at) < F.lit(end).cast("timestamp_ntz"))
    return df if org_id is None else df.filter(F.col("org_id") == org_id)


def exact_percentile(column: str, p: float, where: Column | None = None) -> Column:
    """Linear-interpolated percentile; rows outside ``where`` do not count; null without rows."""
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.percentile(value, F.lit(p))


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def usage_totals(usage: DataFrame, start=None, end=None, org_id=None) -> DataFrame:
    """Calls, tokens, cost and errors of a range and an organisation; percentiles over answered calls that went well only. Evaluation traffic is left out."""
    own = scoped(usage, start, end, org_id).filter(F.col("eval_run_id").isNull())
    totals = own.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("operation") == "answer").alias("answers"),
        total("input_tokens").alias("input_tokens"),
        total("cached_tokens").alias("cached_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("reasoning_tokens").alias("reasoning_tokens"),
        total("cost_usd").cast("double").alias("cost_usd"),
        F.count_if(F.col("status") == "error").alias("errors"),
        cache_hit_percent().alias("cache_hit_pct"),
    )
    well = own.filter(answered())
    share = {f"p{n}{name}_ms": (F.col(f"{column}_ms"), n / 100) for column, name in (("latency", ""), ("ttft", "_ttft")) for n in (50, 95)}
    return totals.crossJoin(F.broadcast(exact_percentiles(well, [], share)))  # a row each


def cache_hit_percent() -> Column:
    """100 * cached / input to two digits, 0 without input."""
    return F.when(total("input_tokens") > 0, F.round(100 * total("cached_tokens") / total("input_tokens"), 2)).otherwise(F.lit(0.0))


def feedback_totals(messages: DataFrame) -> DataFrame:
    own = messages.filter(~F.col("is_eval"))
    return own.agg(
        F.count_if(F.col("role") == "user").alias("questions"),
        F.count_if(F.col("role") == "assistant").alias("answers"),
        F.count_if(F.col("feedback") == 1).alias("up"),
        F.count_if(F.col("feedback") == -1).alias("down"),
    )


def spine(df: DataFrame, start: str, end: str, grain: str) -> DataFrame:
    """Buckets from the truncated start to end - 1 microsecond; a week may begin before start."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[grain]
    text = f"explode(sequence(cast(date_trunc('{grain}', timestamp_ntz'{start}') as timestamp_ntz), timestamp_ntz'{end}' - INTERVAL 1 MICROSECOND, {step})) AS bucket"
    return df.sparkSession.range(1).selectExpr(text)


def usage_series(usage: DataFrame, start: str, end: str, grain: str) -> DataFrame:
    """One row for each bucket: counts are 0 and percentiles null in empty ones."""
    rows = scoped(usage, start, end).filter(F.col("eval_run_id").isNull())
    grouped = rows.groupBy(F.date_trunc(grain, "created_at").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("_calls"), F.sum("cost_usd").alias("_cost"), F.sum("output_tokens").alias("_out"),
        F.countDistinct("request_id").alias("_requests"), exact_percentile("latency_ms", 0.95, answered()).alias("p95_ms"),
    )
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return spine(usage, start, end, grain).join(grouped, "bucket", "left").select("bucket", zero("_calls", "calls"), zero("_requests", "requests"), zero("_out", "output_tokens"), F.coalesce(F.col("_cost").cast("double"), F.lit(0.0)).alias("cost_usd"), "p95_ms")


def by_operation(usage: DataFrame) -> DataFrame:
    return usage.filter(F.col("eval_run_id").isNull()).groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").cast("double").alias("cost_usd"), F.round(F.avg("latency_ms")).alias("avg_ms"),
    )


def by_model_tier(usage: DataFrame) -> DataFrame:
    tier = F.coalesce("tier_actual", "tier_requested", F.lit("standard")).alias("tier")
    answer = F.col("operation") == "answer"
    return usage.filter(F.col("eval_run_id").isNull()).groupBy("model", tier).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd"), F.count_if(answer).alias("answers"),
        F.coalesce(F.sum(F.when(answer, F.col("cost_usd"))), F.lit(0)).cast("double").alias("answer_cost"),
    )


def top_users(usage: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """The n users of most cost, then most requests, then smallest id; a user without a name row stays."""
    sums = usage.groupBy("user_id").agg(F.countDistinct("request_id").alias("requests"), F.sum("cost_usd").cast("double").alias("cost_usd"))
    top = sums.orderBy(F.desc("cost_usd"), F.desc("requests"), "user_id").limit(n)
    return top.join(users, "user_id", "left")


def by_agent(messages: DataFrame, cost: DataFrame) -> DataFrame:
    """Messages by routed department: each department of a message counts it with its whole cost.

    ``messages`` has departments (array) and bypassed; without departments it is
    "Scoped" if bypassed, else "General".
    """
    agents = F.when(F.size("departments") > 0, F.col("departments")).otherwise(F.array(F.when(F.col("bypassed"), "Scoped").otherwise("General")))
    each = messages.select("id", "feedback", F.explode(agents).alias("agent")).join(cost, "id", "left")
    return each.groupBy("agent").agg(
        F.countDistinct("id").alias("messages"), F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col("feedback") == 1).alias("up"), F.count_if(F.col("feedback") == -1).alias("down"),
    )


def top_documents(citations: DataFrame, n: int = 10) -> DataFrame:
    """Most cited codes: citations, distinct messages, a title."""
    sums = citations.groupBy("doc_code").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("message_id").alias("messages"), F.max("title").alias("title"))
    return sums.orderBy(F.desc("citations"), "doc_code").limit(n)


def org_overview(orgs: DataFrame, counted: dict[str, DataFrame], cost: DataFrame) -> DataFrame:
    """Each organisation with its row counts in other tables and a cost; what it has none of is 0."""
    out = orgs
    for name, df in counted.items():
        out = out.join(df.groupBy("org_id").agg(F.count(F.lit(1)).alias(f"_{name}")), "org_id", "left").withColumn(name, F.coalesce(f"_{name}", F.lit(0))).drop(f"_{name}")
    sums = cost.groupBy("org_id").agg(F.sum("cost_usd").cast("double").alias("_cost"))
    return out.join(sums, "org_id", "left").withColumn("cost_usd", F.coalesce("_cost", F.lit(0.0))).drop("_cost")


def personal_totals(messages: DataFrame) -> DataFrame:
    answer, complete = F.col("role") == "assistant", (F.col("role") == "assistant") & (F.col("status") == "complete")
    return messages.filter(~F.col("is_eval")).groupBy("user_id").agg(
        F.count_if(F.col("role") == "user").alias("questions"), F.count_if(answer).alias("answers"),
        F.count_if(answer & (F.col("status") == "stopped")).alias("stopped"), F.count_if(answer & (F.col("status") == "failed")).alias("failed"),
        F.count_if(F.col("feedback") == 1).alias("up"), F.count_if(F.col("feedback") == -1).alias("down"), F.count("bookmarked_at").alias("bookmarks"),
        exact_percentile("total_ms", 0.5, complete).alias("p50_ms"), exact_percentile("total_ms", 0.95, complete).alias("p95_ms"),
        F.avg(F.when(complete, F.col("total_ms"))).alias("avg_ms"),
    )


def personal_series(messages: DataFrame, usage: DataFrame, user_id: int, start: str, end: str, grain: str = "day") -> DataFrame:
    """Two grouped frames on one spine."""
    bucket = F.date_trunc(grain, "created_at").cast("timestamp_ntz").alias("bucket")
    asked = scoped(messages, start, end).filter((F.col("user_id") == user_id) & (F.col("role") == "user")).groupBy(bucket).agg(F.count(F.lit(1)).alias("_q"))
    spent = scoped(usage, start, end).filter(F.col("user_id") == user_id).groupBy(bucket).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("_t"))
    out = spine(messages, start, end, grain).join(asked, "bucket", "left").join(spent, "bucket", "left")
    return out.select("bucket", F.coalesce("_q", F.lit(0)).alias("questions"), F.coalesce("_t", F.lit(0)).alias("tokens"))


def run_usage(usage: DataFrame) -> DataFrame:
    """Evaluation runs: calls, first and last time, errors and cost."""
    return usage.filter(F.col("eval_run_id").isNotNull()).groupBy("eval_run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.count_if(F.col("status") != "ok").alias("errors"), F.sum("cost_usd").cast("double").alias("cost_usd"),
    )


def run_usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.filter(F.col("eval_run_id").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd"))


def candidate_counts(df: DataFrame, batch: str, kind: str, flags: dict[str, Column]) -> DataFrame:
    """Counts of each flag by batch and by batch and kind (kind null in the totals), in one pass."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in flags.items())]
    return df.groupingSets([[df[batch]], [df[batch], df[kind]]], df[batch], df[kind]).agg(*aggs, F.grouping(kind).cast("int").alias("is_total"))


def org_counts(orgs: DataFrame, docs: DataFrame, members: DataFrame, messages: DataFrame, usage: DataFrame) -> DataFrame:
    """Every organisation with its documents, members, conversations and cost; each is counted before the join, evaluation traffic left out."""
    n = lambda df, what, name: df.groupBy("org_id").agg(what.alias(name))
    parts = [
        n(docs, F.count(F.lit(1)), "documents"), n(members, F.count(F.lit(1)), "members"), n(messages.filter(~F.col("is_eval")), F.countDistinct("conv_id"), "conversations"),
        n(usage.filter(F.col("eval_run_id").isNull()), F.sum("cost_usd").cast("double"), "cost"),
    ]
    for p in parts:
        orgs = orgs.join(p, "org_id", "left")
    return orgs.fillna(0, ["documents", "members", "conversations", "cost"])


def personal_tokens(usage: DataFrame, messages: DataFrame) -> DataFrame:
    """(user_id, tokens, calls, bookmarks) of users with calls or messages, evaluation traffic left out."""
    spent = usage.filter(F.col("eval_run_id").isNull()).groupBy("user_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count(F.lit(1)).alias("calls"))
    marks = messages.filter(~F.col("is_eval")).groupBy("user_id").agg(F.count("bookmarked_at").alias("bookmarks"))
    return spent.join(marks, "user_id", "full_outer").select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "calls", "bookmarks")])
