"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import statistics as S
from evalloom.operators.resampling import bootstrap_means
from evalloom.operators.set_similarity import nearest_sets
from evalloom.plans.registry import query
from evalloom.sources.standins import duck, table

_W = "(1.959963984540054 * 1.959963984540054)"


def wilson_sql(p, n):
    half = f"1.959963984540054 * sqrt(({p}/{n}) * (1 - {p}/{n}) / {n} + {_W} / (4 * {n} * {n})) / (1 + {_W} / {n})"
    centre = f"({p}/{n} + {_W} / (2 * {n})) / (1 + {_W} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest({centre} - {half}, 0) END AS low, CASE WHEN {n} > 0 THEN least({centre} + {half}, 1) END AS high"


def _pairs(spark, d):
    s = table(spark, d, "run_scores").filter("status = 'done'")
    side = lambda run: s.filter(F.col("run") == run).select("case_key", *[F.col(c).alias(f"{c}_{run.lower()}") for c in ("hit", "faithfulness", "latency_ms")], *(["flag"] if run == "A" else []))
    return side("A").join(side("B"), "case_key")


_PAIRS = duck("run_scores") + """, pairs AS (SELECT a.case_key, a.flag, a.hit AS hit_a, b.hit AS hit_b, a.faithfulness AS faithfulness_a, b.faithfulness AS faithfulness_b, a.latency_ms AS latency_ms_a, b.latency_ms AS latency_ms_b
FROM run_scores a JOIN run_scores b USING (case_key) WHERE a.run = 'A' AND b.run = 'B' AND a.status = 'done' AND b.status = 'done')"""


@query("sta03_wilson", f"WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, count(*) FILTER (WHERE value > 100)::DOUBLE AS p FROM events GROUP BY 1) SELECT event_type, {wilson_sql('p', 'n')} FROM g")
def wilson(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("p"))
    low, high = S.wilson(F.col("p"), F.col("n"))
    return g.select("event_type", low.alias("low"), high.alias("high"))


@query("sta01_slice_aggregates", duck("run_scores") + f""", e AS (SELECT unnest(['all', 'type:' || type, 'flag:' || flag]) AS slice, run AS metric, hit, CASE WHEN status = 'error' THEN 'error' WHEN faithfulness > 0.09 THEN 'na' ELSE 'ok' END AS status FROM run_scores),
g AS (SELECT slice, metric, count(*) FILTER (WHERE status = 'ok') AS n, avg(hit) FILTER (WHERE status = 'ok') AS mean, count(*) FILTER (WHERE status = 'ok' AND hit >= 0.5) AS passed, count(*) FILTER (WHERE status = 'na') AS n_na, count(*) FILTER (WHERE status = 'error') AS n_error FROM e GROUP BY 1, 2)
SELECT *, {wilson_sql('passed', 'n::DOUBLE')} FROM g""")
def slice_aggregates(spark, d):
    s = table(spark, d, "run_scores")
    status = F.when(F.col("status") == "error", "error").when(F.col("faithfulness") > 0.09, "na").otherwise("ok")
    e = s.select(F.explode(S.slices({"type": F.col("type"), "flag": F.col("flag")})).alias("slice"), F.col("run").alias("metric"), "hit", status.alias("status"))
    return S.slice_aggregates(e, "slice", "metric", "hit", "status")


@query("sta04_bootstrap")
def bootstrap(spark, d):
    return bootstrap_means(table(spark, d, "run_scores"), ["run", "type"], "faithfulness", "boot")


@query("sta07_mcnemar_counts", _PAIRS + """ SELECT flag, count(*) AS n, count(*) FILTER (WHERE hit_a >= 0.5 AND hit_b < 0.5) AS a_only, count(*) FILTER (WHERE hit_b >= 0.5 AND hit_a < 0.5) AS b_only FROM pairs GROUP BY flag""")
def mcnemar_counts(spark, d):
    return S.paired_binary(_pairs(spark, d), "hit_a", "hit_b", ["flag"]).select("flag", "n", "a_only", "b_only")


@query("sta07_mcnemar_p")
def mcnemar_p(spark, d):
    """The counts with their p; tests hold p against exact integers."""
    return S.paired_binary(_pairs(spark, d), "hit_a", "hit_b", ["flag"]).select("flag", "n", "a_only", "b_only", "p")


@query("sta07_mcnemar_exact", """WITH t AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1), e AS (SELECT *, unnest(range(0, least(a, b) + 1)) AS i FROM t)
SELECT o_custkey, a, b, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))) END, 9) AS p FROM e GROUP BY o_custkey, a, b""")
def mcnemar_exact(spark, d):
    """Orders of one status against another's, for each customer."""
    a, b = F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0)), F.count_if(F.col("o_orderstatus") == "O")
    t = table(spark, d, "orders").groupBy("o_custkey").agg(a.alias("a"), b.alias("b"))
    return t.select("o_custkey", "a", "b", F.round(S.mcnemar(F.col("a"), F.col("b")), 9).alias("p"))


@query("sta08_agresti_min", _PAIRS + """, c AS (SELECT flag, count(*) + 2 AS n, (count(*) FILTER (WHERE hit_a >= 0.5 AND hit_b < 0.5) + 0.5::DOUBLE) AS a, (count(*) FILTER (WHERE hit_b >= 0.5 AND hit_a < 0.5) + 0.5::DOUBLE) AS b FROM pairs GROUP BY flag)
SELECT flag, greatest(b/n - a/n - 1.959963984540054 * sqrt(greatest(0, (a/n + b/n - (b/n - a/n) * (b/n - a/n)) / n)), -1) AS low, least(b/n - a/n + 1.959963984540054 * sqrt(greatest(0, (a/n + b/n - (b/n - a/n) * (b/n - a/n)) / n)), 1) AS high FROM c""")
def agresti(spark, d):
    return S.paired_binary(_pairs(spark, d), "hit_a", "hit_b", ["flag"]).select("flag", "low", "high")


@query("sta05_paired_continuous")
def continuous(spark, d):
    return S.paired_continuous(_pairs(spark, d), "faithfulness_a", "faithfulness_b", ["flag"])


@query("sta09_holm", """WITH t AS (SELECT n_nationkey AS k, n_regionkey AS fam, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE (n_nationkey * 37 % 100) / 1000.0::DOUBLE END AS p FROM nation),
r AS (SELECT *, p * (count(*) OVER (PARTITION BY fam, p IS NOT NULL) - row_number() OVER (PARTITION BY fam, p IS NOT NULL ORDER BY p, k) + 1) AS s FROM t)
SELECT k, p, CASE WHEN p IS NOT NULL THEN least(1.0, max(s) OVER (PARTITION BY fam, p IS NOT NULL ORDER BY p, k)) END AS p_holm FROM r""")
def holm(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("fam"), F.when(F.col("n_nationkey") % 6 != 0, (F.col("n_nationkey") * 37 % 100) / 1000.0).alias("p"))
    return S.holm(t, "p", by=["fam"]).select("k", "p", "p_holm")


@query("sta11_change_class", _PAIRS + """ SELECT case_key, CASE WHEN (hit_a >= 0.5) = (hit_b >= 0.5) THEN 'unchanged' WHEN hit_b > hit_a THEN 'improved' ELSE 'regressed' END AS hit,
CASE WHEN abs(latency_ms_b - latency_ms_a) <= 0.1 * greatest(abs(latency_ms_a), abs(latency_ms_b)) THEN 'unchanged' WHEN latency_ms_b > latency_ms_a THEN 'improved' ELSE 'regressed' END AS latency FROM pairs""")
def change_class(spark, d):
    p = _pairs(spark, d)
    return p.select("case_key", S.change_class(F.col("hit_a"), F.col("hit_b"), "binary").alias("hit"), S.change_class(F.col("latency_ms_a"), F.col("latency_ms_b"), "relative").alias("latency"))


@query("sta12_comparison", _PAIRS + """, k AS (SELECT CASE WHEN (hit_a >= 0.5) = (hit_b >= 0.5) THEN 'unchanged' WHEN hit_b > hit_a THEN 'improved' ELSE 'regressed' END AS c FROM pairs)
SELECT count(*) AS paired, count(*) FILTER (WHERE c = 'improved') AS improved, count(*) FILTER (WHERE c = 'regressed') AS regressed, (count(*) - count(*) FILTER (WHERE c = 'unchanged')) / count(*) AS flip_rate FROM k""")
def comparison(spark, d):
    c = _pairs(spark, d).select(S.change_class(F.col("hit_a"), F.col("hit_b"), "binary").alias("c"))
    n = lambda v: F.count_if(F.col("c") == v)
    return c.agg(F.count(F.lit(1)).alias("paired"), n("improved").alias("improved"), n("regressed").alias("regressed"), ((F.count(F.lit(1)) - n("unchanged")) / F.count(F.lit(1))).alias("flip_rate"))


@query("sta16_confusion", "SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return S.confusion(rows, "a", "b")


def _kappa_sql(weight, k):
    return f"""WITH r AS (SELECT l_returnflag AS g, (l_linenumber % {k})::INT AS a, (l_partkey % {k})::INT AS b FROM lineitem), n AS (SELECT g, count(*)::DOUBLE AS n, sum({weight('a', 'b')}) AS o FROM r GROUP BY g),
ma AS (SELECT g, a, count(*)::DOUBLE AS c FROM r GROUP BY 1, 2), mb AS (SELECT g, b, count(*)::DOUBLE AS c FROM r GROUP BY 1, 2), e AS (SELECT ma.g, sum(ma.c * mb.c * {weight('a', 'b')}) AS e FROM ma JOIN mb ON ma.g = mb.g GROUP BY 1)
SELECT g, n::BIGINT AS n, 1 - o / (e / n) AS kappa FROM n JOIN e USING (g)"""


@query("sta17_kappa", _kappa_sql(lambda a, b: f"CASE WHEN {a} <> {b} THEN 1.0 ELSE 0 END::DOUBLE", 3))
def kappa(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_returnflag AS g", "cast(l_linenumber % 3 as int) AS a", "cast(l_partkey % 3 as int) AS b")
    return S.kappa(r, "a", "b", 3, by=["g"])


@query("sta17_weighted_kappa", _kappa_sql(lambda a, b: f"(({a} - {b}) * ({a} - {b}) / 16.0)::DOUBLE", 5))
def weighted_kappa(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_returnflag AS g", "cast(l_linenumber % 5 as int) AS a", "cast(l_partkey % 5 as int) AS b")
    return S.kappa(r, "a", "b", 5, quadratic=True, by=["g"])


@query("sta18_spearman", """WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem) SELECT g, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY g""", ("rho",))
def spearman(spark, d):
    return S.spearman(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_discount", ["g"])


@query("sta19_agreement", "SELECT l_returnflag AS g, count(*) AS n, 100 * avg((l_linenumber = l_partkey % 5)::INT) AS exact, 100 * avg((abs(l_linenumber - l_partkey % 5) <= 1)::INT) AS within1, avg(abs(l_linenumber - l_partkey % 5)) AS mae, avg(l_linenumber - l_partkey % 5) AS bias FROM lineitem GROUP BY 1")
def agreement(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_returnflag AS g", "l_linenumber AS j", "l_partkey % 5 AS h")
    return S.agreement(r, "j", "h", ["g"])


@query("sta20_calibration_status", "SELECT n_nationkey AS k, CASE WHEN n_nationkey * 3 < 20 OR n_nationkey % 5 = 0 THEN 'uncalibrated' WHEN n_nationkey / 25 < 0.4 THEN 'unreliable' WHEN n_nationkey / 25 < 0.6 OR n_nationkey * 3 < 30 THEN 'moderate' ELSE 'calibrated' END AS status FROM nation")
def status(spark, d):
    n = table(spark, d, "nation")
    k = F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") / 25)
    return n.select(F.col("n_nationkey").alias("k"), S.calibration_status(F.col("n_nationkey") * 3, k).alias("status"))


_SEEDED = "sha256('7' || chr(31) || CAST(event_id AS VARCHAR))"


@query("sta22_stratified_sample", f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_SEEDED}) AS nth FROM events) ORDER BY nth, event_type LIMIT 23")
def stratified(spark, d):
    return S.stratified_sample(table(spark, d, "events"), ["event_type"], "event_id", 23, 7).select("event_id", "event_type")


@query("sta23_random_sample", f"SELECT event_id FROM events ORDER BY {_SEEDED}, event_id LIMIT 40")
def random_sample(spark, d):
    return S.random_sample(table(spark, d, "events"), "event_id", 40, 7).select("event_id")


@query("sta24_disagreement", "SELECT l_orderkey, l_linenumber, least(greatest(abs(l_discount - l_tax) * 4, abs(l_quantity / 50 - l_discount * 10), 0), 1)::DOUBLE AS d FROM lineitem")
def disagreement(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.disagreement(F.abs(F.col("l_discount") - F.col("l_tax")) * 4, F.abs(F.col("l_quantity") / 50 - F.col("l_discount") * 10)).alias("d"))


@query("sta27_allocation", """WITH w AS (SELECT source AS k, count(*)::DOUBLE AS w FROM documents GROUP BY 1), s AS (SELECT *, (100 - count(*) OVER ()) * w / sum(w) OVER () AS share, count(*) OVER () AS n FROM w),
f AS (SELECT *, floor(share) AS fl, share - floor(share) AS rest FROM s) SELECT k, CAST(1 + fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= 100 - n - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM f""")
def allocation(spark, d):
    w = table(spark, d, "documents").groupBy(F.col("source").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return S.allocate(w, "k", "w", 100)


@query("sta38_weighted_draw", f"SELECT event_id FROM events WHERE value > 0 ORDER BY -ln((('0x' || substr({_SEEDED}, 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496) / value, event_id LIMIT 10")
def draw(spark, d):
    return S.weighted_draw(table(spark, d, "events"), "event_id", "value", 10, 7).select("event_id")


_SET = r"list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("sta30_nearest_duplicate", f"""WITH s AS (SELECT item_id, {_SET} AS t FROM benchmark), j AS (SELECT a.item_id, b.item_id AS other, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard FROM s a JOIN s b ON a.item_id <> b.item_id)
SELECT item_id, other, jaccard FROM j WHERE jaccard > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, other) = 1""")
def nearest(spark, d):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    return nearest_sets(table(spark, d, "benchmark").select("item_id", words.alias("t")), "item_id", "t")


_TRI = r"CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE [] END"
_WORDS = r"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query("sta29_copy_overlap", f"""WITH q AS (SELECT item_id, {_TRI} AS t FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), c AS (SELECT doc_id, {_TRI} AS t FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
g AS (SELECT item_id, unnest(t) AS g, len(t) AS n FROM q), h AS (SELECT doc_id, unnest(t) AS g FROM c) SELECT item_id, round(max(c / n), 4) AS overlap FROM (SELECT item_id, doc_id, count(*) AS c, max(n) AS n FROM g JOIN h USING (g) GROUP BY 1, 2) GROUP BY 1""")
def overlap(spark, d):
    return _overlap(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query("sta29_copy_overlap_all")
def overlap_all(spark, d):
    return _overlap(table(spark, d, "benchmark"), table(spark, d, "documents"))


def _overlap(items, docs):
    q = items.select("item_id", T.trigrams(F.col("text")).alias("t")).select("item_id", F.size("t").alias("n"), F.explode("t").alias("g"))
    # a document's other trigrams go before anything is exchanged
    c = docs.select("doc_id", F.explode(T.trigrams(F.col("text"))).alias("g")).join(q.select("g").distinct(), "g", "left_semi")
    per = q.join(c, "g").groupBy("item_id", "doc_id").agg((F.count(F.lit(1)) / F.max("n")).alias("s"))
    return per.groupBy("item_id").agg(F.round(F.max("s"), 4).alias("overlap"))


@query("hsh01_seed64", "SELECT n_nationkey AS k, ('0x' || substr(sha256(n_name || chr(31) || CAST(n_regionkey AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE AS seed FROM nation")
def seed(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), T.seed64(F.col("n_name"), F.col("n_regionkey").cast("string")).cast("double").alias("seed"))
