"""Queries of small rules that stand inside larger operators: cells, excerpts, defused tags, front matter, labels, verdicts, overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import config
from evalloom.functions import text as T
from evalloom.operators import analytics as A
from evalloom.operators import documents as D
from evalloom.operators import evaluation as E
from evalloom.operators import metrics as M
from evalloom.operators import relational as R
from evalloom.plans.registry import query
from evalloom.sources import files
from evalloom.sources.session import python_ready
from evalloom.sources.standins import duck, table


@query("src08_front_matter", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS title, CASE WHEN n_nationkey % 3 > 0 THEN 2 ELSE 0 END AS fields, CASE WHEN n_nationkey % 3 > 0 THEN '' ELSE '--- ' END || 'Body of ' || n_name || chr(10) || '---' || chr(10) || 'end' AS body FROM nation")
def front_matter(spark, d):
    body = F.concat(F.lit("Body of "), "n_name", F.lit("\n---\nend"))
    text = F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("---\ntitle:  "), F.col("n_name"), F.lit(" \nno field\nurl: http://x:1\n---\n"), body)).otherwise(F.concat(F.lit("--- "), body))
    rows = files.front_matter(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), text.alias("text")), "k", "text")
    return rows.select("k", F.try_element_at("header", F.lit("title")).alias("title"), F.size("header").alias("fields"), "body")


@query("flt04_escaped_search", r"SELECT p_partkey FROM part WHERE p_partkey % 4 = 1 AND contains(lower(p_name), 's')")
def escaped_search(spark, d):
    shown = F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, ("", "_S%", "xS%", "_Sx"))), (F.col("p_partkey") % 4).cast("int") + 1))
    rows = table(spark, d, "part").filter(F.lower("p_name").contains("s")).select("p_partkey", shown.alias("shown"))
    return rows.filter(R.contains_any("_s%", "shown")).select("p_partkey")


@query("str07_cells", "SELECT n_nationkey AS k, 'AB-CD-' || n_name || ' of x' AS cell, '' AS nothing FROM nation")
def cells(spark, d):
    raw = F.concat(F.lit(" AB- \n CD-\n"), "n_name", F.lit("\n\n of \t x "))
    raw = F.regexp_replace(raw, r"AB- \n CD", "AB-\n CD")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), T.cell(raw).alias("cell"), T.cell(F.lit(None).cast("string")).alias("nothing"))


@query("str12_content_types", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_suppkey % 5 = 0 THEN 'revision_history' WHEN l_suppkey % 5 = 1 THEN 'glossary' WHEN l_quantity > 25 THEN 'table' WHEN l_quantity < 10 THEN 'list' WHEN l_suppkey % 5 = 2 THEN 'appendix' ELSE 'prose' END AS kind FROM lineitem""")
def content_types(spark, d):
    path = F.element_at(F.array(*map(F.lit, ("A › Change  log › Version History", "Terms › Definitions", "Appendices", "Appendixes", "Leave"))), (F.col("l_suppkey") % 5).cast("int") + 1)
    path = F.regexp_replace(path, "Change  log › ", "")
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", D.content_type(q, F.when(q < 10, 26).otherwise(0), F.lit(50), path).alias("kind"))


@query("str15_excerpts", r"SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(substr(t, 1, 400), '\s+\S*$', '') || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(regexp_replace('Known [1]. Twice [2, 3]. ' || text, '\s*\[\d+(?:\s*,\s*\d+)*\]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents)")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.concat(F.lit("Known [1]. Twice [2, 3]. "), "text")).alias("excerpt"))


@query("str25_defused_tags", "SELECT n_nationkey AS k, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' <\\/source> x' ELSE ' </sources> x' END AS t FROM nation")
def defused(spark, d):
    raw = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " </ Source > x").otherwise(" </sources> x"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), T.defused(raw, "source").alias("t"))


@query("met01_relevance", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_suppkey % 7 IN (1, 3) AND (l_orderkey % 2 = 0 OR (l_suppkey % 7 = 1 AND l_linenumber = 2)) AS rel FROM lineitem")
def relevance(spark, d):
    code = F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit("D-"), F.col("l_suppkey") % 7))
    docs = F.array(F.lit("D-1"), F.lit("D-3"))
    sections = F.when(F.col("l_orderkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("D-1 §2")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", M.relevant(code, F.col("l_linenumber").cast("string"), docs, sections).alias("rel"))


@query("met23_verdicts", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = 'A' OR l_suppkey % 9 = 0 THEN NULL WHEN l_returnflag = 'N' THEN l_discount >= 0.05 ELSE l_discount <= 0.02 END AS passed FROM lineitem")
def verdicts(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "na").otherwise("ok")
    value = F.when(F.col("l_suppkey") % 9 > 0, F.col("l_discount"))
    higher = F.col("l_returnflag") == "N"
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", M.passed(value, status, F.when(higher, 0.05).otherwise(0.02), F.when(higher, "higher").otherwise("lower")).alias("passed"))


@query("join12_org_overview", duck("docs", "messages", "usage") + """, n AS (SELECT n_nationkey AS org_id, n_name AS name FROM nation), dd AS (SELECT org_id, count(*) AS n FROM docs GROUP BY 1), c AS (SELECT org_id, count(DISTINCT conv_id) AS n FROM messages WHERE NOT is_eval GROUP BY 1),
u AS (SELECT org_id, sum(cost_usd)::DOUBLE AS cost FROM usage WHERE eval_run_id IS NULL AND created_at >= TIMESTAMP '2024-01-15' - INTERVAL 10 DAY GROUP BY 1), m AS (SELECT c_nationkey AS org_id, count(*) AS n FROM customer GROUP BY 1)
SELECT org_id, name, coalesce(dd.n, 0) AS documents, coalesce(m.n, 0) AS members, coalesce(c.n, 0) AS conversations, coalesce(cost, 0) AS cost FROM n LEFT JOIN dd USING (org_id) LEFT JOIN c USING (org_id) LEFT JOIN u USING (org_id) LEFT JOIN m USING (org_id)""", ("cost",))
def org_overview(spark, d):
    orgs = table(spark, d, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"))
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("org_id"))
    return A.org_counts(orgs, table(spark, d, "docs"), members, table(spark, d, "messages"), A.scoped(table(spark, d, "usage"), "2024-01-05 00:00:00"))


@query("agg13_personal_tokens", duck("messages", "usage") + ", u AS (SELECT user_id, sum(input_tokens + output_tokens)::BIGINT AS tokens, count(*) AS calls FROM usage WHERE eval_run_id IS NULL GROUP BY 1), b AS (SELECT user_id, count(bookmarked_at) AS bookmarks FROM messages WHERE NOT is_eval GROUP BY 1) SELECT user_id, coalesce(tokens, 0) AS tokens, coalesce(calls, 0) AS calls, coalesce(bookmarks, 0) AS bookmarks FROM u FULL JOIN b USING (user_id)")
def personal_tokens(spark, d):
    return A.personal_tokens(table(spark, d, "usage"), table(spark, d, "messages"))


@query("map01_flat_config", """SELECT event_id, 'a.k=' || regexp_extract(props, '[0-9]+') || ';a.m.x="y";l=[1, {"z": 2}]' AS flat FROM events""")
def flat_config(spark, d):
    python_ready(spark)
    text = F.concat(F.lit('{"l": [1, {"z": 2}], "a": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "m": {"x": "y"}, "gone": {}, "none": null}}'))
    flat = config.flat_config(text)
    rows = table(spark, d, "events").select("event_id", flat.alias("m"))
    return rows.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("flat"))


@query("srt05_conversation_page", duck("messages") + ", c AS (SELECT conv_id, max(created_at) AS made FROM messages GROUP BY 1) SELECT conv_id FROM c WHERE (made, conv_id) < (TIMESTAMP '2024-01-05 12:00:00', 100) ORDER BY made DESC, conv_id DESC LIMIT 21")
def conversation_page(spark, d):
    c = table(spark, d, "messages").groupBy("conv_id").agg(F.max("created_at").alias("at"))
    at, key = R.read_cursor(R.cursor("2024-01-05 12:00:00", 100))
    return R.keyset_page(c, "at", "conv_id", 20, before=(at, key)).select("conv_id")


@query("doc06_cleaned_tables", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '||x' ELSE n_name || '|x' END AS first, CASE WHEN n_nationkey % 2 = 0 THEN 'a|b|' ELSE 'a|' END AS second, 2 AS rows FROM nation")
def cleaned_tables(spark, d):
    none = F.lit(None).cast("string")
    t = F.array(F.array(none, F.lit(" ")), F.array(F.lit(""), F.col("n_name"), none, F.lit("x ")), F.array(none, F.lit(" a"), F.when(F.col("n_nationkey") % 2 == 0, "b")))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), E.table_cleaned(t).alias("t"))
    return rows.select("k", F.array_join(F.col("t")[0], "|").alias("first"), F.array_join(F.col("t")[1], "|").alias("second"), F.size("t").alias("rows"))
