"""Metric queries: orders as cases, line items as contexts, claims and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import metrics as M
from evalloom.plans.registry import query
from evalloom.sources.standins import duck, table

_CTX = "SELECT l_orderkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, 'D-' || CAST(l_suppkey % 7 AS STRING) AS doc, l_returnflag = 'R' AS rel FROM lineitem"


def _contexts(spark, d):
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("c"), rank.alias("rank"), F.concat(F.lit("D-"), F.col("l_suppkey") % 7).alias("doc"), (F.col("l_returnflag") == "R").alias("rel"))


@query("met02_ranking_metrics", f"""WITH x AS ({_CTX}), p AS (SELECT *, sum(rel::INT) OVER (PARTITION BY c ORDER BY rank) / rank AS pr FROM x)
SELECT c, coalesce(CAST(min(CASE WHEN rel AND rank <= 8 THEN rank END) <= 5 AS INT), 0) AS hit5, CAST(min(CASE WHEN rel AND rank <= 8 THEN rank END) IS NOT NULL AS INT) AS hitk,
coalesce(1.0 / min(CASE WHEN rel AND rank <= 8 THEN rank END), 0)::DOUBLE AS mrr, coalesce(avg(rel::INT) FILTER (WHERE rank <= 8), 0) AS precision, coalesce(avg(CASE WHEN rel THEN pr END), 0) AS avg_precision FROM p GROUP BY c""")
def ranking(spark, d):
    return M.ranking_metrics(_contexts(spark, d), "c")


@query("met06_ndcg", f"""WITH x AS ({_CTX}), w AS (SELECT o_orderkey AS c, unnest(['D-1', 'D-2', 'D-' || CAST(o_custkey % 7 AS STRING)]) AS doc FROM orders), u AS (SELECT DISTINCT c, doc FROM w),
f AS (SELECT c, doc, min(rank) AS r FROM x JOIN u USING (c, doc) WHERE rank <= 8 GROUP BY 1, 2), n AS (SELECT c, count(*) AS n FROM u GROUP BY c), g AS (SELECT c, sum(1 / log2(r + 1)) AS dcg FROM f GROUP BY c)
SELECT c, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 8) + 1), lambda r: 1 / log2(r + 1))) AS ndcg FROM n LEFT JOIN g USING (c)""", ("ndcg",))
def ndcg(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("c"), F.explode(F.array(F.lit("D-1"), F.lit("D-2"), F.concat(F.lit("D-"), F.col("o_custkey") % 7))).alias("doc"))
    return M.ndcg(_contexts(spark, d), "c", "doc", wanted)


@query("met04_recall", f"""WITH x AS ({_CTX}), s AS (SELECT c, list(DISTINCT doc) AS found FROM x GROUP BY c) SELECT c, len(list_intersect(['D-1', 'D-3', 'D-5'], found)) / 3 AS recall, 3 - len(list_intersect(['D-1', 'D-3', 'D-5'], found)) AS missing FROM s""")
def recall(spark, d):
    want = F.array(F.lit("D-1"), F.lit("D-3"), F.lit("D-5"))
    s = _contexts(spark, d).groupBy("c").agg(F.collect_set("doc").alias("found"))
    return s.select("c", M.recall(F.col("found"), want).alias("recall"), F.size(F.array_except(want, F.col("found"))).cast("long").alias("missing"))


@query("met07_routing_jaccard", """WITH s AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)
SELECT user_id, len(list_intersect(t, ['click', 'view'])) / len(list_distinct(list_concat(t, ['click', 'view']))) AS jaccard, CAST(len(list_intersect(t, ['click', 'view'])) > 0 AS INT) AS hit FROM s""")
def routing(spark, d):
    want = F.array(F.lit("click"), F.lit("view"))
    s = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return s.select("user_id", M.set_jaccard(F.col("t"), want).alias("jaccard"), F.arrays_overlap("t", want).cast("int").alias("hit"))


_CITED = "SELECT o_orderkey AS c, 'See [' || CAST(o_custkey % 5 AS STRING) || ', ' || CAST(o_custkey % 9 AS STRING) || '] and [2].' AS answer FROM orders"


@query("met09_citation_validity", f"""WITH a AS ({_CITED}), m AS (SELECT c, unnest(regexp_extract_all(array_to_string(regexp_extract_all(answer, '\\[[0-9, ]+\\]'), ' '), '[0-9]+'))::INT AS n FROM a)
SELECT c, count(*) FILTER (WHERE n BETWEEN 1 AND 4) / count(*) AS validity FROM m GROUP BY c""")
def validity(spark, d):
    a = table(spark, d, "orders").selectExpr("o_orderkey AS c", "concat('See [', o_custkey % 5, ', ', o_custkey % 9, '] and [2].') AS answer")
    return a.select("c", M.citation_validity(F.col("answer"), F.lit(4)).alias("validity"))


@query("met11_page_hit", f"""WITH e AS (SELECT o_orderkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'D-' || CAST(o_custkey % 7 AS STRING) END AS code, o_custkey % 40 AS first, o_custkey % 40 + 5 AS last FROM orders),
x AS (SELECT l_orderkey AS c, 'D-' || CAST(l_suppkey % 7 AS STRING) AS doc_code, l_partkey % 45 AS ps, l_partkey % 45 + 2 AS pe FROM lineitem)
SELECT e.c, max(CASE WHEN x.c IS NULL THEN 0 ELSE 1 END) AS page_hit FROM e LEFT JOIN x ON e.c = x.c AND ps <= last AND pe >= first AND (code IS NULL OR code = doc_code) GROUP BY e.c""")
def page_hit(spark, d):
    e = table(spark, d, "orders").selectExpr("o_orderkey AS c", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('D-', o_custkey % 7) END AS code", "o_custkey % 40 AS first", "o_custkey % 40 + 5 AS last")
    x = table(spark, d, "lineitem").selectExpr("l_orderkey AS c", "concat('D-', l_suppkey % 7) AS doc_code", "l_partkey % 45 AS page_start", "l_partkey % 45 + 2 AS page_end")
    return M.page_hit(x, e, "c")


_CLAIMS = "SELECT l_orderkey AS c, CASE l_returnflag WHEN 'R' THEN 'contradicted' WHEN 'A' THEN 'supported' WHEN 'N' THEN CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'supported' END END AS verdict, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 3 END AS cite, l_suppkey % 3 AS sup FROM lineitem"


@query("met18_claim_metrics", f"""WITH k AS (SELECT c, coalesce(verdict, 'not_found') AS v, cite IS NOT NULL AS cited, coalesce(cite = sup, false) AS meets FROM ({_CLAIMS}))
SELECT c, count(*) FILTER (WHERE v = 'supported') / count(*) AS faithfulness, CAST(count(*) FILTER (WHERE v = 'contradicted') > 0 OR count(*) FILTER (WHERE v = 'not_found') / count(*) > 0.2 AS INT) AS hallucination,
count(*) FILTER (WHERE cited) / count(*) AS citation_recall, count(*) FILTER (WHERE cited AND meets) / nullif(count(*) FILTER (WHERE cited), 0) AS citation_precision,
count(*) FILTER (WHERE v = 'supported' AND cited AND meets) / nullif(count(*) FILTER (WHERE v = 'supported'), 0) AS supported_recall FROM k GROUP BY c""")
def claims(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS c", "CASE l_returnflag WHEN 'R' THEN 'contradicted' WHEN 'A' THEN 'supported' WHEN 'N' THEN CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'supported' END END AS verdict",
        "CASE WHEN l_partkey % 4 = 0 THEN cast(array() AS array<bigint>) ELSE array(l_partkey % 3) END AS citation_ns", "array(l_suppkey % 3) AS supporting_ns")
    return M.claim_metrics(rows, "c")


@query("met19_fact_recall", """WITH f AS (SELECT l_orderkey AS c, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity - 10 END AS weight, CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'partial' END AS verdict FROM lineitem),
w AS (SELECT c, greatest(coalesce(weight, 1), 0) AS w, CASE verdict WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END::DOUBLE AS credit FROM f) SELECT c, sum(w * credit) / nullif(sum(w), 0) AS fact_recall FROM w GROUP BY c""")
def facts(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS c", "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity - 10 END AS weight", "CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'partial' END AS verdict")
    return M.fact_recall(rows, "c")


@query("met17_behaviour", """WITH b AS (SELECT event_id, ['answer', 'refuse', 'clarify', 'clarify_or_variations', 'answer_ignoring_injection'][1 + event_id % 5] AS e, ['answered', 'abstained', 'clarified'][1 + event_id % 3] AS o, event_id % 11 = 0 AS f FROM events)
SELECT event_id, CAST(NOT f AND CASE e WHEN 'refuse' THEN o = 'abstained' WHEN 'clarify' THEN o = 'clarified' WHEN 'clarify_or_variations' THEN o IN ('clarified', 'answered') ELSE o = 'answered' END AS INT) AS correct FROM b""")
def behaviour(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "array('answer', 'refuse', 'clarify', 'clarify_or_variations', 'answer_ignoring_injection')[event_id % 5] AS e", "array('answered', 'abstained', 'clarified')[event_id % 3] AS o", "event_id % 11 = 0 AS f")
    return e.select("event_id", M.behaviour_correct(F.col("e"), F.col("o"), F.col("f")).alias("correct"))


@query("met13_leakage", duck("messages") + r""", a AS (SELECT id, lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(coalesce(lag(content) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\s+', ' ', 'g'))) AS u, role FROM messages)
SELECT id, CAST((contains(t, 'the') AND NOT contains(u, 'the')) OR (contains(t, 'que la') AND NOT contains(u, 'que la')) AS INT) AS leak FROM a WHERE role = 'assistant'""")
def leak(spark, d):
    from pyspark.sql.window import Window

    m = table(spark, d, "messages").withColumn("u", F.coalesce(F.lag("content").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return m.filter("role = 'assistant'").select("id", M.leakage(F.col("content"), F.col("u"), ["the", "que  LA"]).alias("leak"))


@query("met24_gate", duck("run_scores") + """, s AS (SELECT case_key, 'hit' AS metric, 'ok' AS status, hit >= 0.5 AS passed FROM run_scores UNION ALL SELECT case_key, 'faith', CASE WHEN status = 'error' THEN 'error' WHEN faithfulness > 0.09 THEN 'na' ELSE 'ok' END, faithfulness >= 0.01 FROM run_scores)
SELECT case_key, NOT bool_or(status = 'error' OR (status = 'ok' AND NOT passed)) AS passed FROM s GROUP BY case_key""")
def gate(spark, d):
    s = table(spark, d, "run_scores")
    hit = s.select("case_key", F.lit("hit").alias("metric"), F.lit("ok").alias("status"), (F.col("hit") >= 0.5).alias("passed"))
    faith = s.select("case_key", F.lit("faith").alias("metric"), F.when(F.col("status") == "error", "error").when(F.col("faithfulness") > 0.09, "na").otherwise("ok").alias("status"), (F.col("faithfulness") >= 0.01).alias("passed"))
    return M.gate(hit.unionByName(faith), "case_key", ["hit", "faith"])


@query("met21_sample_quality", "SELECT l_orderkey AS c, median((l_linenumber - 1) / 4) AS value, stddev_pop((l_linenumber - 1) / 4) AS spread, count(*) AS n_samples FROM lineitem GROUP BY 1", ("value", "spread"))
def quality(spark, d):
    return M.sample_quality(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("score")), "c")


@query("met12_operational", duck("usage") + " SELECT request_id, sum(latency_ms) AS latency_ms, min(ttft_ms) AS ttft_ms, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost FROM usage GROUP BY 1")
def operational(spark, d):
    return table(spark, d, "usage").groupBy("request_id").agg(F.sum("latency_ms").alias("latency_ms"), F.min("ttft_ms").alias("ttft_ms"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_usd").cast("double").alias("cost"))


@query("mth08_category", "SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor(l_discount * 10 * 4 + 0.5), 0), 4) AS INT) AS cat FROM lineitem")
def category(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.category(F.col("l_discount") * 10, 5).alias("cat"))
