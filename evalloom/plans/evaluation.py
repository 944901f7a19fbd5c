"""Queries of the evaluation operators and of the remaining catalogue patterns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions import text as T
from evalloom.operators import evaluation as E
from evalloom.operators import relational as R
from evalloom.operators.ranks import exact_percentiles
from evalloom.plans.registry import query
from evalloom.sources.standins import duck, table


@query("ret13_routing", "SELECT o_orderkey, array_to_string(CASE o_custkey % 3 WHEN 0 THEN ['HR', 'IT'] WHEN 1 THEN ['IT'] ELSE [] END, ',') AS departments, o_custkey % 3 = 2 AS clarify FROM orders")
def routing(spark, d):
    raw = F.when(F.col("o_custkey") % 3 == 0, F.array(*map(F.lit, ("HR", "x", "IT", "HR")))).when(F.col("o_custkey") % 3 == 1, F.array(F.lit("IT"))).otherwise(F.array(F.lit("zz")))
    rows = E.routed(table(spark, d, "orders").select("o_orderkey", "o_custkey", raw.alias("departments")), ["HR", "IT", "Legal"])
    return rows.select("o_orderkey", F.array_join("departments", ",").alias("departments"), "clarify")


@query("ret14_search_filters", duck("docs") + ", f AS (SELECT unnest(['src1', 'src2']) AS department) SELECT department, count(*) AS n FROM f JOIN docs USING (department) GROUP BY 1")
def filters(spark, d):
    f = spark.range(1).select(F.explode(F.array(F.lit("src1"), F.lit("src2"))).alias("department"))
    return f.join(table(spark, d, "docs"), "department").groupBy("department").agg(F.count(F.lit(1)).alias("n"))


@query("ret15_citations", """WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 2 THEN [2, 3] ELSE [o_custkey % 4, 2, 3] END AS l FROM orders), e AS (SELECT k, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM m)
SELECT k, n::INT AS n, CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS INT) AS "order" FROM e WHERE n BETWEEN 1 AND 2""")
def citations(spark, d):
    answers = table(spark, d, "orders").selectExpr("o_orderkey AS k", "concat('x [', o_custkey % 4, '] y [2, 3] [2]') AS answer")
    sources = answers.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return E.cited_sources(answers, sources, "k", "answer").select("k", "n", "order")


@query("str26_source_lines", "SELECT p_partkey, '[' || CAST(p_size AS VARCHAR) || '] ' || p_brand || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN ', §' || CAST(p_size AS VARCHAR) ELSE '' END AS line FROM part")
def source_lines(spark, d):
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", E.source_line(size, F.col("p_brand"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, size), F.lit(None).cast("string")).alias("line"))


@query("str11_chunk_headers", "SELECT p_partkey, '[' || p_brand || ' · ' || p_name || ' v' || CAST(p_size AS VARCHAR) || ' · GB' || CASE WHEN p_size % 2 = 0 THEN ' | a › b' ELSE '' END || ']' AS header FROM part")
def headers(spark, d):
    path = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", E.chunk_header(F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string"), F.lit("GB"), F.lit(None).cast("string"), path).alias("header"))


@query("str10_cross_references", "SELECT n_nationkey AS k, array_to_string(list_concat(CASE WHEN n_nationkey % 2 = 0 THEN ['SIM-IT-101'] ELSE [] END, ['3.1', '2.4', '7.2']), ',') AS refs FROM nation")
def cross(spark, d):
    t = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "SIM-IT-101 and ").otherwise(""), F.lit("SIM-HR-001 (3.1) see Section 2.4, (3.1), §7.2"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array_join(E.cross_references(t, F.lit("SIM-HR-001")), ",").alias("refs"))


@query("str08_headings", r"""SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'part' WHEN 1 THEN 'appendix' WHEN 2 THEN 'appendix' WHEN 3 THEN 'numbered' WHEN 4 THEN 'lettered' WHEN 5 THEN 'part' END AS kind,
CASE o_orderkey % 7 WHEN 0 THEN 'Part ' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'B' WHEN 2 THEN '12' WHEN 3 THEN CAST(o_orderkey % 100 AS VARCHAR) || '.1' WHEN 4 THEN 'C' WHEN 5 THEN 'Part IV' END AS number,
CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN 'Schedule 12' WHEN 3 THEN o_orderpriority WHEN 4 THEN o_orderpriority WHEN 5 THEN 'PART IV' ELSE 'Plain ' || o_orderpriority END AS title FROM orders""")
def headings(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    of = [F.concat(F.lit("part "), k, F.lit(" – "), p), F.concat(F.lit("Annex B. "), p), F.lit("Schedule 12"), F.concat(k % 100, F.lit(".1. "), p), F.concat(F.lit("C.  "), p), F.lit("PART IV"), F.concat(F.lit("Plain "), p)]
    line = F.element_at(F.array(*of), (k % 7).cast("int") + 1)
    return table(spark, d, "orders").select(k.alias("k"), E.heading_parts(line).alias("h")).select("k", "h.kind", "h.number", "h.title")


@query("str19_redaction", "SELECT event_id, '***' AS auth, event_type AS kind, substr(props, 1, 5) AS body, length(props) > 5 AS cut FROM events")
def redaction(spark, d):
    e = table(spark, d, "events").select("event_id", E.redacted(F.create_map(F.lit("Authorization"), F.col("props"), F.lit("kind"), F.col("event_type"))).alias("h"), *[c.alias(n) for c, n in zip(E.capped(F.col("props"), 5), ("body", "cut"), strict=True)])
    return e.select("event_id", F.col("h")["Authorization"].alias("auth"), F.col("h")["kind"].alias("kind"), "body", "cut")


@query("str24_topic_words", r"""WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 2) AS w FROM part)
SELECT p_partkey, len(list_distinct(list_filter(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[^s]s$') THEN left(x, length(x) - 1) ELSE x END), lambda x: x NOT IN ('policy', 'procedure', 'guideline', 'manual', 'general')))) AS n FROM w""")
def topics(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(E.topic_words(F.col("p_name"))).cast("long").alias("n"))


@query("str28_markdown_tables", r"""SELECT n_nationkey AS k, '| h | x |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_name || ' | a\|b |' AS md FROM nation""")
def markdown(spark, d):
    t = F.array(F.array(F.lit("h"), F.lit(" x")), F.array(F.lit(""), F.lit(None).cast("string")), F.array(F.col("n_name"), F.lit("a|b")))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), E.markdown_rows(E.table_cleaned(t)).alias("md"))


@query("sta13_noise_floor", duck("run_scores") + " SELECT a.flag, abs(avg(b.faithfulness - a.faithfulness)) AS floor, count(*) AS n FROM run_scores a JOIN run_scores b USING (case_key) WHERE a.run = 'A' AND b.run = 'B' GROUP BY a.flag", ("floor",))
def noise(spark, d):
    s = table(spark, d, "run_scores")
    a, b = (s.filter(F.col("run") == r).select("case_key", F.col("faithfulness").alias(f"f{r}"), F.col("flag").alias(f"flag{r}")) for r in "AB")
    return E.noise_floor(a.join(b, "case_key"), "fA", "fB", ["flagA"]).withColumnRenamed("flagA", "flag")


@query("sta32_check_verdicts", "SELECT l_orderkey, l_linenumber, l_quantity, array_to_string(list_filter([CASE WHEN l_discount * 10 >= 0.6 THEN 'copied' END, CASE WHEN l_tax * 10 >= 0.7 THEN 'duplicate' END, CASE WHEN l_returnflag = 'R' THEN 'ineligible' END], lambda x: x IS NOT NULL), ',') AS failures, CASE WHEN l_discount * 10 >= 0.4 AND l_discount * 10 < 0.6 THEN 'overlap' ELSE '' END AS warnings FROM lineitem")
def verdicts(spark, d):
    bad, warn = E.check_verdict(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_returnflag") != "R")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.array_join(bad, ",").alias("failures"), F.array_join(warn, ",").alias("warnings"))


@query("agg28_case_pass", duck("run_scores") + """, c AS (SELECT run, status, hit >= 0.5 AS passed FROM run_scores) SELECT run, 'case_pass' AS metric, avg(passed::INT) FILTER (WHERE status = 'done') AS value FROM c GROUP BY run UNION ALL SELECT run, 'error_rate', avg((status = 'error')::INT) FROM c GROUP BY run""")
def case_pass(spark, d):
    return E.case_pass_rows(table(spark, d, "run_scores").withColumn("passed", F.col("hit") >= 0.5), "run")


@query("mth06_cost_estimate", "SELECT conv_id, count(*) AS turns, round(count(*) * 0.0012 + count(*) * count(*) FILTER (WHERE role = 'assistant') * 0.003, 6)::DOUBLE AS usd FROM conversations GROUP BY 1")
def estimate(spark, d):
    """Each conversation as a run: its turns are the cases, its answers the checks of each."""
    turns, answers = F.count(F.lit(1)), F.count_if(F.col("role") == "assistant")
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"), E.cost_of(turns, answers).alias("usd"))


@query("agg16_request_detail", duck("usage") + " SELECT request_id, count(*) AS calls, CAST(sum(cost_usd) AS DOUBLE) AS cost, max(latency_ms) AS slowest FROM usage GROUP BY 1")
def detail(spark, d):
    return table(spark, d, "usage").groupBy("request_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("double").alias("cost"), F.max("latency_ms").alias("slowest"))


@query("agg17_chunk_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def chunk_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("agg35_sorted_union", "SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type), ['hq']))), ',') AS u FROM events GROUP BY 1")
def sorted_union(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("event_type"), F.array(F.lit("hq")))), ",").alias("u"))


@query("join02_one_row_stats", "SELECT o_orderkey, o_totalprice / avg_price AS ratio FROM orders, (SELECT avg(o_totalprice) AS avg_price FROM orders)")
def one_row(spark, d):
    o = table(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("m")))).select("o_orderkey", (F.col("o_totalprice") / F.col("m")).alias("ratio"))


@query("join13_review_progress", "SELECT c_custkey, count(o_orderkey) AS items, count(*) FILTER (WHERE o_orderstatus = 'F') AS mine, count(DISTINCT o_orderpriority) AS reviewers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def review_progress(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"), F.countDistinct("o_orderpriority").alias("c"))
    c = table(spark, d, "customer")
    zero = lambda x, n: F.coalesce(x, F.lit(0)).alias(n)
    return c.join(g, c["c_custkey"] == g["o_custkey"], "left").select("c_custkey", zero("a", "items"), zero("b", "mine"), zero("c", "reviewers"))


@query("join16_guarded_left", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def guarded(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, (o["o_custkey"] == c["c_custkey"]) & (o["o_orderstatus"] == "F"), "left").select("o_orderkey", "c_name")


@query("join23_reference_graph", "WITH r AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS code FROM lineitem) SELECT a, s_name FROM r JOIN supplier ON s_suppkey = code")
def references(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("codes")).select(F.col("l_orderkey").alias("a"), F.explode("codes").alias("s_suppkey"))
    return r.join(table(spark, d, "supplier"), "s_suppkey").select("a", "s_name")


@query("srt06_offset_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.with_total(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50).select("o_orderkey", "total")


@query("srt08_message_order", duck("messages") + " SELECT id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY created_at, role DESC, id) AS INT) AS pos FROM messages")
def message_order(spark, d):
    return table(spark, d, "messages").select("id", F.row_number().over(Window.partitionBy("conv_id").orderBy("created_at", F.desc("role"), "id")).alias("pos"))


@query("srt10_newest_then_oldest", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)")
def newest(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)
    return top.orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("srt11_regressions_first", duck("run_scores") + " SELECT case_key, run, CASE WHEN hit = 0 AND status = 'done' THEN 0 WHEN status = 'error' THEN 1 ELSE 2 END AS r FROM run_scores ORDER BY r, case_key, run LIMIT 100")
def regressions(spark, d):
    r = F.when((F.col("hit") == 0) & (F.col("status") == "done"), 0).when(F.col("status") == "error", 1).otherwise(2)
    return table(spark, d, "run_scores").select("case_key", "run", r.alias("r")).orderBy("r", "case_key", "run").limit(100)


@query("set02_union_all", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("str23_jaccard", r"""WITH s AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM benchmark)
SELECT a.item_id, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard FROM s a JOIN s b ON b.item_id = a.item_id + 1""")
def jaccard(spark, d):
    s = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")).alias("t"))
    other = s.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return s.join(other, "item_id").select("item_id", T.jaccard(F.col("t"), F.col("u")).alias("jaccard"))


@query("mth03_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentiles(spark, d):
    return exact_percentiles(table(spark, d, "events"), ["event_type"], {"p50": (F.col("value"), 0.5), "p95": (F.col("value"), 0.95)})


@query("doc16_synced_columns", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def synced(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority")
