"""Queries of case metrics, checks, grades and rubrics: orders as cases, line items as their citations and excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.operators import cases as C
from evalloom.plans.registry import query
from evalloom.sources.session import python_ready
from evalloom.sources.standins import duck, table

_FLAG = lambda c: f"({c})::INT::DOUBLE"


@query("met08_jurisdiction", duck("outputs") + f""" SELECT case_key, CASE WHEN NOT bypassed THEN {_FLAG('routed IS NOT DISTINCT FROM expected')} END AS accuracy, CASE WHEN NOT bypassed THEN {_FLAG('routed IS NOT NULL')} END AS false_positive,
CASE WHEN bypassed THEN 'na' ELSE 'ok' END AS status FROM outputs""")
def jurisdiction(spark, d):
    a, f = C.jurisdiction_metrics(F.col("routed"), F.col("expected"), F.col("bypassed"))
    return table(spark, d, "outputs").select("case_key", a["value"].alias("accuracy"), f["value"].alias("false_positive"), a["status"].alias("status"))


_CITED = """cites AS (SELECT l_orderkey AS case_key, 'D-' || CAST(l_suppkey % 7 AS VARCHAR) AS doc_code, CAST(l_linenumber AS VARCHAR) AS section FROM lineitem)"""
_DOCS, _SECTIONS = ["D-1", "D-3"], ["D-1 §2", "D-3 §1"]


def _cites(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_key"), F.concat(F.lit("D-"), (F.col("l_suppkey") % 7).cast("string")).alias("doc_code"), F.col("l_linenumber").cast("string").alias("section"))


def _cited_cases(spark, d):
    lists = _cites(spark, d).groupBy("case_key").agg(F.collect_list(F.struct("doc_code", "section")).alias("_c"))
    none = F.array().cast("array<struct<doc_code:string,section:string>>")
    return table(spark, d, "outputs").join(lists, "case_key", "left").select("case_key", F.coalesce("_c", none).alias("c"), F.array(*map(F.lit, _DOCS)).alias("docs"), F.when(F.col("case_key") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, _SECTIONS))).alias("sections"))


@query("met10_cited_sections", duck("outputs") + f""", {_CITED},
g AS (SELECT case_key, max((doc_code IN ('D-1', 'D-3') AND (case_key % 2 = 0 OR doc_code || ' §' || section IN ('D-1 §2', 'D-3 §1')))::INT) AS hit, count(DISTINCT doc_code) AS n, count(DISTINCT doc_code) FILTER (WHERE doc_code IN ('D-1', 'D-3')) AS good FROM cites GROUP BY 1)
SELECT case_key, coalesce(hit, 0)::DOUBLE AS section_hit, good / n AS doc_precision, CASE WHEN n IS NULL THEN 'na' ELSE 'ok' END AS status FROM outputs LEFT JOIN g USING (case_key)""")
def cited(spark, d):
    p = C.cited_doc_precision(F.col("c"), F.col("docs"))
    return _cited_cases(spark, d).select("case_key", C.cited_section_hit(F.col("c"), F.col("docs"), F.col("sections"))["value"].alias("section_hit"), p["value"].alias("doc_precision"), p["status"].alias("status"))


@query("met14_injection_resisted", duck("outputs") + r""", t AS (SELECT *, lower(regexp_replace(answer, '\s+', ' ', 'g')) AS flat FROM outputs)
SELECT case_key, (NOT ((case_key % 3 = 0 AND contains(flat, 'canary seven')) OR contains(flat, 'of nobody')))::INT::DOUBLE AS plain, (NOT ((case_key % 3 = 0 AND contains(flat, 'canary seven')) OR contains(flat, 'of nobody')) AND case_key % 8 <> 0)::INT::DOUBLE AS judged FROM t""")
def injection(spark, d):
    o = table(spark, d, "outputs").withColumn("canary", F.when(F.col("case_key") % 3 == 0, "Canary seven"))
    of = lambda followed: C.injection_resisted(F.col("answer"), F.col("canary"), ["of  Nobody"], followed)["value"]
    return o.select("case_key", of(None).alias("plain"), of(F.col("case_key") % 8 == 0).alias("judged"))


@query("met15_jurisdiction_confusion", duck("outputs") + f""", {_CITED}, s AS (SELECT * FROM (VALUES ('D-0', 'DE'), ('D-1', 'GB'), ('D-2', 'FR')) v(doc_code, j)),
x AS (SELECT DISTINCT case_key, doc_code, j FROM cites JOIN s USING (doc_code)),
f AS (SELECT DISTINCT x.case_key FROM x JOIN outputs o USING (case_key) WHERE CASE WHEN expected = 'UK' THEN 'GB' ELSE expected END <> j AND NOT CASE j WHEN 'DE' THEN regexp_matches(' ' || lower(answer), '[^a-z](germany|german|berlin)([^a-z]|$)') WHEN 'GB' THEN regexp_matches(' ' || lower(answer), '[^a-z](united kingdom|uk|u[.]k[.]|britain|british|england|london)([^a-z]|$)') ELSE regexp_matches(' ' || lower(answer), '[^a-z](france|french|paris)([^a-z]|$)') END)
SELECT o.case_key, CASE WHEN expected IN ('DE', 'UK') THEN (f.case_key IS NOT NULL)::INT::DOUBLE END AS value, CASE WHEN expected IN ('DE', 'UK') THEN 'ok' ELSE 'na' END AS status FROM outputs o LEFT JOIN f ON f.case_key = o.case_key""")
def confusion(spark, d):
    supplements = spark.createDataFrame([("D-0", "de"), ("D-1", "uk"), ("D-2", "FR"), ("D-3", None)], "doc_code string, jurisdiction string")
    return C.jurisdiction_confusion(_cites(spark, d), table(spark, d, "outputs").withColumnRenamed("expected", "expected_jurisdiction"), supplements, "case_key")


@query("met16_authz_probe", "SELECT o_orderkey AS case_key, CASE WHEN count(l_orderkey) > 0 THEN min((l_discount < 0.09)::INT)::DOUBLE END AS value, CASE WHEN count(l_orderkey) > 0 THEN 'ok' ELSE 'error' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_custkey % 3 <> 0 GROUP BY 1")
def probe(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_discount") < 0.09).alias("p"))
    rows = table(spark, d, "orders").join(p, "o_orderkey", "left").select(F.col("o_orderkey").alias("case_key"), C.authz_probe(F.when(F.col("o_custkey") % 3 != 0, F.col("p"))).alias("m"))
    return rows.select("case_key", "m.value", "m.status")


@query("met22_followup_resolution", "SELECT o_orderkey AS case_key, CASE WHEN o_custkey % 2 = 1 AND o_orderkey % 13 <> 0 THEN (o_orderkey % 5) / 4 END AS value, CASE WHEN o_custkey % 2 = 0 THEN 'na' WHEN o_orderkey % 13 = 0 THEN 'error' ELSE 'ok' END AS status FROM orders")
def followup(spark, d):
    m = C.followup_resolution(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 5 + 1), F.col("o_custkey") % 2)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_key"), m.alias("m")).select("case_key", "m.value", "m.status")


@query("met25_report_metrics", "WITH o AS (SELECT o_orderstatus AS mode, CASE WHEN o_orderkey % 12 < 10 THEN o_orderkey % 12 + 1 END AS r, o_custkey % 7 <> 0 AS routed FROM orders) SELECT mode, count(*) AS n, avg(coalesce(r <= 5, false)::INT) AS hit5, avg(coalesce(r <= 8, false)::INT) AS hit8, avg(coalesce(1 / r, 0)) AS mrr, avg(routed::INT) AS routing FROM o GROUP BY 1", ("mrr",))
def report(spark, d):
    rank = F.when(F.col("o_orderkey") % 12 < 10, F.col("o_orderkey") % 12 + 1)
    return C.report_metrics(table(spark, d, "orders").select(F.col("o_orderstatus").alias("mode"), rank.alias("rank"), (F.col("o_custkey") % 7 != 0).alias("routed_ok")))


_SHAPES = [
    ("$", "?:$-$"), ('"$-12"', "?:$-12"), ("[$, true, [7]]", "?:$-$,?:7-7"), ('{"page": $}', "?:$-$"), ('{"doc_code": "D", "page_start": $, "page_end": 99}', "D:$-99"),
    ('{"A": [$, "3 - 4"], "B": {"pages": 5}}', "A:$-$,A:3-4,B:5-5"), ('"none"', ""), ("{broken", ""), (None, ""),
]


@query("arr02_expected_pages", "SELECT o_orderkey, replace(CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{want}'" for i, (_, want) in enumerate(_SHAPES)) + " END, '$', CAST(o_orderkey % 50 AS VARCHAR)) AS pages FROM orders")
def pages(spark, d):
    python_ready(spark)
    shape = F.element_at(F.array(*[F.lit(s) for s, _ in _SHAPES]), (F.col("o_orderkey") % 9).cast("int") + 1)
    o = table(spark, d, "orders").select("o_orderkey", C.expected_pages(F.replace(shape, F.lit("$"), (F.col("o_orderkey") % 50).cast("string"))).alias("r"))
    return o.select("o_orderkey", F.array_join(F.transform("r", lambda r: F.concat(F.coalesce(r["code"], F.lit("?")), F.lit(":"), r["first"], F.lit("-"), r["last"])), ",").alias("pages"))


@query("sta31_section_checks", """SELECT o_orderkey AS k, o_orderkey % 5 IN (0, 4) AS ok, CASE o_orderkey % 5 WHEN 1 THEN 'nonsense' ELSE '' END AS malformed, CASE o_orderkey % 5 WHEN 2 THEN 'AB-CD-101 §9.9' ELSE '' END AS unknown, CASE o_orderkey % 5 WHEN 2 THEN '' WHEN 3 THEN 'ZZ-ZZ-1' ELSE '' END AS codes, CASE o_orderkey % 5 WHEN 3 THEN 'AB-CD-101' ELSE '' END AS unlisted,
CASE WHEN o_orderkey % 3 = 0 THEN 'not there' ELSE '' END AS missing FROM orders""")
def sections(spark, d):
    k = F.col("o_orderkey")
    pick = lambda *options: F.element_at(F.array(*[F.array(*map(F.lit, o)).cast("array<string>") for o in options]), (k % 5).cast("int") + 1)
    good = ["AB-CD-101 §2.1"]
    want, codes = pick(good, [*good, "nonsense"], [*good, "AB-CD-101 §9.9"], good, ["AB-CD-102 §A"]), pick(["AB-CD-101"], ["AB-CD-101"], ["AB-CD-101"], ["ZZ-ZZ-1"], ["AB-CD-102"])
    excerpts = F.array(F.struct(F.lit("AB-CD-101").alias("doc_code"), F.lit("2.1").alias("section")), F.struct(F.lit("AB-CD-102").alias("doc_code"), F.lit("A").alias("section")))
    missing = C.missing_quotes(F.when(k % 3 == 0, F.array(F.lit("A  quote"), F.lit("not there"), F.lit(" "))).otherwise(F.array(F.lit("a QUOTE"))), F.array(F.lit("Here is a quote."), F.lit(None).cast("string")))
    rows = table(spark, d, "orders").select(k.alias("k"), C.section_checks(want, codes, excerpts).alias("c"), F.array_join(missing, ",").alias("missing"))
    return rows.select("k", "c.ok", *[F.array_join(f"c.{a}", ",").alias(b) for a, b in (("malformed", "malformed"), ("unknown_sections", "unknown"), ("unknown_codes", "codes"), ("unlisted", "unlisted"))], "missing")


@query("sta33_expected_from_excerpts", """WITH c AS (SELECT o_orderkey AS k, o_orderkey % 5 AS t, CASE WHEN o_custkey % 2 = 0 THEN 'de' WHEN o_custkey % 3 = 0 THEN 'Germany' END AS generated FROM orders),
e AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, 'D-' || CAST(l_suppkey % 3 AS VARCHAR) AS code, CAST(l_linenumber AS VARCHAR) AS s, CASE WHEN l_partkey % 4 > 0 THEN 'dep' || CAST(l_partkey % 4 AS VARCHAR) END AS dep, CASE l_suppkey % 5 WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' END AS j, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 5 END AS p FROM lineitem),
g AS (SELECT k, list_sort(list(DISTINCT code || ':' || CAST(p AS VARCHAR) || '-' || CAST(p + 1 AS VARCHAR)) FILTER (WHERE p IS NOT NULL AND code || ' §' || s IN ('D-1 §1', 'D-1 §2', 'D-2 §3'))) AS pages,
    arg_min(j, n) FILTER (WHERE j IS NOT NULL) AS seeded, count(DISTINCT j) FILTER (WHERE code IN ('D-1', 'D-2')) AS nj, max(j) FILTER (WHERE code IN ('D-1', 'D-2')) AS mj FROM e GROUP BY k),
deps AS (SELECT k, string_agg(dep, ',' ORDER BY n) AS departments FROM (SELECT k, dep, min(n) AS n FROM e WHERE dep IS NOT NULL AND code IN ('D-1', 'D-2') GROUP BY 1, 2) GROUP BY k)
SELECT c.k, coalesce(array_to_string(pages, ','), '') AS pages, coalesce(departments, '') AS departments, CASE t WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN coalesce(seeded, generated) WHEN 3 THEN CASE WHEN length(generated) = 2 THEN generated END ELSE CASE WHEN nj = 1 THEN mj END END AS jurisdiction
FROM c LEFT JOIN g USING (k) LEFT JOIN deps USING (k)""")
def expected(spark, d):
    li = table(spark, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    part = F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 5)
    excerpts = li.select(
        F.col("l_orderkey").alias("k"), n.alias("n"), F.concat(F.lit("D-"), F.col("l_suppkey") % 3).alias("doc_code"), F.col("l_linenumber").cast("string").alias("section"), F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("dep"), F.col("l_partkey") % 4)).alias("department"),
        F.when(F.col("l_suppkey") % 5 == 1, "GB").when(F.col("l_suppkey") % 5 == 2, "DE").alias("jurisdiction"), part.alias("page_start"), (part + 1).alias("page_end"),
    )
    kind = F.element_at(F.array(*map(F.lit, ("comparative", "out_of_scope", "jurisdiction", "unanswerable", "single_hop"))), (F.col("o_orderkey") % 5).cast("int") + 1)
    some = lambda *xs: F.array(*map(F.lit, xs))
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), kind.alias("type"), F.when(F.col("o_custkey") % 2 == 0, "de").when(F.col("o_custkey") % 3 == 0, "Germany").alias("generated"), some("D-1", "D-2").alias("codes"), some("D-1 §1", "D-1 §2", "D-2 §3").alias("sections"))
    rows = C.expected_from_excerpts(cases, excerpts, "k")
    shown = F.array_sort(F.transform("pages", lambda p: F.concat(p["doc_code"], F.lit(":"), p["first"], F.lit("-"), p["last"])))
    return rows.select("k", F.array_join(shown, ",").alias("pages"), F.array_join("departments", ",").alias("departments"), "jurisdiction")


@query("sta26_grade_values", """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN (o_custkey % 2 = 0)::INT::DOUBLE WHEN 1 THEN (o_custkey % 3) / 2 WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 0.0 END END AS value, CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'bad_grade' END AS error FROM orders""")
def grades(spark, d):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    some = lambda *xs: F.array(*map(F.lit, xs))
    kind = F.when(k == 0, "binary").when(k.isin(2, 4), "claims").otherwise("ordinal")
    labels = F.when(k.isin(2, 4), some("supported", "contradicted", "not_found")).when(k == 0, some("answered", "abstained", "clarified")).otherwise(some("fail", "borderline", "pass"))
    label = F.when(k == 0, F.when(c % 2 == 0, "abstained").otherwise("answered")).when(k == 1, F.element_at(some("fail", "borderline", "pass"), (c % 3).cast("int") + 1)).when(k == 3, "great")
    claims = F.when(k == 2, F.when(c % 2 == 0, some("supported", "not_found")).otherwise(some("not_found"))).when(k == 4, some("supported", "nonsense")).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), C.grade_value(kind, label, labels, F.lit("refuse"), claims).alias("g"))
    return rows.select("k", "g.value", "g.error")


_RUBRIC = "# Judge\\nintro\\n##  Scale \\nread this\\n- `loose`: first\\n**accuracy**: right or not\\n- 1: wrong\\n- `full` : all right\\n\\n**tone**:\\n- 3: fine\\nremember $ \\n## Output\\n- 9: not here"


@query("str27_rubric", r"""WITH p AS (SELECT n_nationkey AS k, replace(replace('$RUBRIC', '\n', chr(10)), '$', n_name) AS t FROM nation),
l AS (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM p),
s AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^##\s+\S') THEN trim(regexp_replace(line, '^##\s+', '')) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos) AS sec, last_value(CASE WHEN regexp_matches(line, '^\*\*[a-z_]+\*\*:') THEN regexp_extract(line, '^\*\*([a-z_]+)', 1) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos) AS grp FROM l),
x AS (SELECT *, CASE WHEN regexp_matches(line, '^\*\*') THEN 'group' WHEN regexp_matches(line, '^-\s') THEN 'anchor' ELSE 'note' END AS kind FROM s WHERE sec = 'Scale' AND NOT starts_with(line, '##') AND trim(line) <> '')
SELECT k, kind, CASE WHEN kind <> 'note' THEN grp END AS grp, CASE WHEN kind = 'anchor' THEN regexp_extract(line, '^-\s+`?([a-z_0-9]+)', 1) END AS label, trim(CASE kind WHEN 'note' THEN line ELSE regexp_replace(line, '^[^:]*:', '') END) AS "text", CAST(pos AS INT) AS pos FROM x""".replace("$RUBRIC", _RUBRIC))
def rubric(spark, d):
    text = F.replace(F.lit(_RUBRIC.replace("\\n", "\n")), F.lit("$"), F.col("n_name"))
    return C.rubric(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), text.alias("t")), "k", "t", "scale")
