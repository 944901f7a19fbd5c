"""Analytics queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import analytics as A
from evalloom.plans.registry import query
from evalloom.sources.standins import duck, table

START, END = "2024-01-03 00:00:00", "2024-01-24 00:00:00"
_OK = "operation = 'answer' AND status = 'ok'"


@query("agg01_usage_totals", duck("usage") + f"""
SELECT count(*) AS calls, count(*) FILTER (WHERE operation = 'answer') AS answers, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached_tokens,
CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(reasoning_tokens), 0) AS BIGINT) AS reasoning_tokens, CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS cost_usd, count(*) FILTER (WHERE status = 'error') AS errors,
quantile_cont(latency_ms, 0.5) FILTER (WHERE {_OK}) AS p50_ms, quantile_cont(latency_ms, 0.95) FILTER (WHERE {_OK}) AS p95_ms,
quantile_cont(ttft_ms, 0.5) FILTER (WHERE {_OK}) AS p50_ttft_ms, quantile_cont(ttft_ms, 0.95) FILTER (WHERE {_OK}) AS p95_ttft_ms,
CASE WHEN sum(input_tokens) > 0 THEN round(100 * sum(cached_tokens)::DOUBLE / sum(input_tokens), 2) ELSE 0.0 END AS cache_hit_pct
FROM usage WHERE eval_run_id IS NULL AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' AND org_id = 1""")
def usage_totals(spark, d):
    return A.usage_totals(table(spark, d, "usage"), START, END, 1)


@query("agg02_message_feedback", duck("messages") + """
SELECT count(*) FILTER (WHERE role = 'user') AS questions, count(*) FILTER (WHERE role = 'assistant') AS answers, count(*) FILTER (WHERE feedback = 1) AS up, count(*) FILTER (WHERE feedback = -1) AS down
FROM messages WHERE NOT is_eval""")
def feedback(spark, d):
    return A.feedback_totals(table(spark, d, "messages"))


def _series_sql(grain, step):
    return duck("usage") + f""", spine AS (SELECT unnest(generate_series(date_trunc('{grain}', TIMESTAMP '{START}'), TIMESTAMP '{END}' - INTERVAL 1 MICROSECOND, INTERVAL {step})) AS bucket),
g AS (SELECT date_trunc('{grain}', created_at) AS bucket, count(*) AS calls, count(DISTINCT request_id) AS requests, sum(output_tokens) AS o, sum(cost_usd) AS c, quantile_cont(latency_ms, 0.95) FILTER (WHERE {_OK}) AS p95_ms
FROM usage WHERE eval_run_id IS NULL AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY 1)
SELECT s.bucket::TIMESTAMP AS bucket, coalesce(calls, 0) AS calls, coalesce(requests, 0) AS requests, CAST(coalesce(o, 0) AS BIGINT) AS output_tokens, CAST(coalesce(c, 0) AS DOUBLE) AS cost_usd, p95_ms
FROM spine s LEFT JOIN g ON s.bucket::TIMESTAMP = g.bucket::TIMESTAMP"""


@query("agg03_usage_series_day", _series_sql("day", "1 DAY"), ("p95_ms",))
def series_day(spark, d):
    return A.usage_series(table(spark, d, "usage"), START, END, "day")


@query("agg03_usage_series_week", _series_sql("week", "7 DAY"), ("p95_ms",))
def series_week(spark, d):
    return A.usage_series(table(spark, d, "usage"), START, END, "week")


@query("agg04_by_operation", duck("usage") + """
SELECT operation, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, round(avg(latency_ms)) AS avg_ms
FROM usage WHERE eval_run_id IS NULL GROUP BY operation""")
def by_operation(spark, d):
    return A.by_operation(table(spark, d, "usage"))


@query("agg05_by_model_tier", duck("usage") + """
SELECT model, coalesce(tier_actual, tier_requested, 'standard') AS tier, count(*) AS calls, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) FILTER (WHERE operation = 'answer') AS answers,
CAST(coalesce(sum(cost_usd) FILTER (WHERE operation = 'answer'), 0) AS DOUBLE) AS answer_cost FROM usage WHERE eval_run_id IS NULL GROUP BY 1, 2""")
def by_model(spark, d):
    return A.by_model_tier(table(spark, d, "usage"))


_ROUTED = """routed AS (SELECT id, feedback, turn % 3 = 0 AS bypassed, CASE turn % 4 WHEN 0 THEN [] WHEN 1 THEN ['HR'] WHEN 2 THEN ['HR', 'IT'] ELSE ['Legal'] END AS departments FROM messages WHERE role = 'assistant'),
cost AS (SELECT message_id AS id, sum(cost_usd) AS cost_usd FROM usage GROUP BY 1)"""


@query("agg06_by_agent", duck("messages", "usage") + ", " + _ROUTED + """, each AS (SELECT id, feedback, unnest(CASE WHEN len(departments) > 0 THEN departments WHEN bypassed THEN ['Scoped'] ELSE ['General'] END) AS agent FROM routed)
SELECT agent, count(DISTINCT id) AS messages, CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS cost_usd, count(*) FILTER (WHERE feedback = 1) AS up, count(*) FILTER (WHERE feedback = -1) AS down
FROM each LEFT JOIN cost USING (id) GROUP BY agent""")
def by_agent(spark, d):
    names = "CASE turn % 4 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array('HR') WHEN 2 THEN array('HR', 'IT') ELSE array('Legal') END AS departments"
    routed = table(spark, d, "messages").filter("role = 'assistant'").selectExpr("id", "feedback", "turn % 3 = 0 AS bypassed", names)
    cost = table(spark, d, "usage").groupBy(F.col("message_id").alias("id")).agg(F.sum("cost_usd").alias("cost_usd"))
    return A.by_agent(routed, cost)


@query("agg07_top_users", duck("usage") + """
, s AS (SELECT user_id, count(DISTINCT request_id) AS requests, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM usage GROUP BY 1 ORDER BY cost_usd DESC, requests DESC, user_id LIMIT 10)
SELECT user_id, requests, cost_usd, c_name FROM s LEFT JOIN (SELECT c_custkey AS user_id, c_name FROM customer) USING (user_id)""")
def top_users(spark, d):
    return A.top_users(table(spark, d, "usage"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"))


@query("agg08_top_documents", duck("messages") + """
, c AS (SELECT id AS message_id, 'DOC-' || CAST(n AS STRING) AS doc_code, 'Title ' || CAST(n AS STRING) AS title FROM (SELECT id, unnest([conv_id % 20, turn % 7]) AS n FROM messages WHERE role = 'assistant'))
SELECT doc_code, count(*) AS citations, count(DISTINCT message_id) AS messages, max(title) AS title FROM c GROUP BY doc_code ORDER BY citations DESC, doc_code LIMIT 10""")
def top_documents(spark, d):
    cites = table(spark, d, "messages").filter("role = 'assistant'").selectExpr("id AS message_id", "explode(array(conv_id % 20, turn % 7)) AS n")
    return A.top_documents(cites.selectExpr("message_id", "concat('DOC-', n) AS doc_code", "concat('Title ', n) AS title"))


@query("agg10_org_overview", duck("usage", "messages", "docs") + """
SELECT o.org_id, (SELECT count(*) FROM docs x WHERE x.org_id = o.org_id) AS documents, (SELECT count(*) FROM messages x WHERE x.org_id = o.org_id) AS messages,
coalesce((SELECT CAST(sum(cost_usd) AS DOUBLE) FROM usage x WHERE x.org_id = o.org_id AND created_at >= TIMESTAMP '2024-01-10'), 0.0) AS cost_usd
FROM (SELECT CAST(r_regionkey AS BIGINT) AS org_id FROM region) o""")
def overview(spark, d):
    orgs = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("org_id"))
    recent = A.scoped(table(spark, d, "usage"), "2024-01-10 00:00:00")
    return A.org_overview(orgs, {"documents": table(spark, d, "docs"), "messages": table(spark, d, "messages")}, recent)


@query("agg11_personal_totals", duck("messages") + """
SELECT user_id, count(*) FILTER (WHERE role = 'user') AS questions, count(*) FILTER (WHERE role = 'assistant') AS answers, count(*) FILTER (WHERE role = 'assistant' AND status = 'stopped') AS stopped,
count(*) FILTER (WHERE role = 'assistant' AND status = 'failed') AS failed, count(*) FILTER (WHERE feedback = 1) AS up, count(*) FILTER (WHERE feedback = -1) AS down, count(bookmarked_at) AS bookmarks,
quantile_cont(total_ms, 0.5) FILTER (WHERE role = 'assistant' AND status = 'complete') AS p50_ms, quantile_cont(total_ms, 0.95) FILTER (WHERE role = 'assistant' AND status = 'complete') AS p95_ms,
avg(total_ms) FILTER (WHERE role = 'assistant' AND status = 'complete') AS avg_ms FROM messages WHERE NOT is_eval GROUP BY user_id""", ("p50_ms", "p95_ms", "avg_ms"))
def personal(spark, d):
    return A.personal_totals(table(spark, d, "messages"))


@query("agg12_conversations_started", duck("messages") + """
, c AS (SELECT conv_id, min(created_at) AS began FROM messages WHERE NOT is_eval GROUP BY conv_id)
SELECT count(*) AS total, count(*) FILTER (WHERE began >= TIMESTAMP '2024-01-02' AND began < TIMESTAMP '2024-01-05') AS started FROM c""")
def started(spark, d):
    c = table(spark, d, "messages").filter("NOT is_eval").groupBy("conv_id").agg(F.min("created_at").alias("at"))
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("at >= timestamp_ntz'2024-01-02' AND at < timestamp_ntz'2024-01-05'")).alias("started"))


@query("agg14_personal_series", duck("messages", "usage") + """
, spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-15' - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS bucket),
q AS (SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, count(*) AS n FROM messages WHERE user_id = 7 AND role = 'user' AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-15' GROUP BY 1),
t AS (SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, sum(input_tokens + output_tokens) AS n FROM usage WHERE user_id = 7 AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT s.bucket::TIMESTAMP AS bucket, coalesce(q.n, 0) AS questions, CAST(coalesce(t.n, 0) AS BIGINT) AS tokens FROM spine s LEFT JOIN q ON q.bucket = s.bucket::TIMESTAMP LEFT JOIN t ON t.bucket = s.bucket::TIMESTAMP""")
def personal_series(spark, d):
    return A.personal_series(table(spark, d, "messages"), table(spark, d, "usage"), 7, "2024-01-01 00:00:00", "2024-01-15 00:00:00")


@query("agg15_run_usage", duck("usage") + """
SELECT eval_run_id, count(*) AS calls, min(created_at) AS first_at, max(created_at) AS last_at, count(*) FILTER (WHERE status <> 'ok') AS errors, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd
FROM usage WHERE eval_run_id IS NOT NULL GROUP BY 1""")
def run_usage(spark, d):
    return A.run_usage(table(spark, d, "usage"))


@query("agg15_run_usage_by_case", duck("usage") + """
SELECT eval_run_id, eval_case_id, count(*) AS calls, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM usage WHERE eval_run_id IS NOT NULL GROUP BY 1, 2""")
def run_usage_case(spark, d):
    return A.run_usage_by(table(spark, d, "usage"), "eval_run_id", "eval_case_id").orderBy("eval_run_id", F.asc_nulls_first("eval_case_id"))


@query("agg15_run_usage_by_model", duck("usage") + """
SELECT operation, model, count(*) AS calls, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM usage WHERE eval_run_id IS NOT NULL GROUP BY 1, 2""")
def run_usage_model(spark, d):
    return A.run_usage_by(table(spark, d, "usage"), "operation", "model")


@query("agg23_run_counters", duck("run_scores") + """
SELECT run, count(*) AS cases, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum(CASE WHEN status = 'done' AND hit >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS passed
FROM run_scores GROUP BY run""")
def run_counters(spark, d):
    done = F.col("status") == "done"
    return table(spark, d, "run_scores").groupBy("run").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "error").alias("errors"), F.sum(F.when(done & (F.col("hit") >= 0.5), 1).otherwise(0)).alias("passed"))


@query("agg24_status_histogram", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("agg25_candidate_counts", """
SELECT o_orderpriority AS batch, o_orderstatus AS kind, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS approved, CAST(grouping(o_orderstatus) AS INT) AS is_total
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))""")
def candidates(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_orderstatus").alias("kind"), "o_totalprice")
    return A.candidate_counts(rows, "batch", "kind", {"approved": F.col("o_totalprice") > 100000})


@query("agg26_month_to_date", duck("usage") + """
SELECT date_trunc('month', created_at)::DATE AS month, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) AS calls FROM usage WHERE created_at >= date_trunc('month', TIMESTAMP '2024-01-20') GROUP BY 1""")
def month(spark, d):
    u = table(spark, d, "usage").filter("created_at >= cast(date_trunc('month', timestamp_ntz'2024-01-20') as timestamp_ntz)")
    return u.groupBy(F.trunc("created_at", "MM").alias("month")).agg(F.sum("cost_usd").cast("double").alias("cost_usd"), F.count(F.lit(1)).alias("calls"))
