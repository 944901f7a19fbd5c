"""Queries of versions, badges, settings, memberships, samples and seeds: customers as datasets, orders as versions and cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions import text as T
from evalloom.operators import analytics as A
from evalloom.operators import block_index as BI
from evalloom.operators import datasets as D
from evalloom.operators import evaluation as E
from evalloom.operators import retrieval as R
from evalloom.operators import seeds
from evalloom.plans.registry import query
from evalloom.plans.retrieval import _indexed
from evalloom.sources.session import python_ready
from evalloom.sources.standins import duck, table


@query("dat03_range_presets", duck("usage") + """, spine AS (SELECT unnest(generate_series(date_trunc('week', TIMESTAMP '2023-11-01'), TIMESTAMP '2024-02-15' - INTERVAL 1 MICROSECOND, INTERVAL 7 DAY)) AS bucket)
SELECT s.bucket::TIMESTAMP AS bucket, count(id) AS calls FROM spine s LEFT JOIN usage u ON date_trunc('week', created_at) = s.bucket AND eval_run_id IS NULL AND created_at >= TIMESTAMP '2023-11-01' AND created_at < TIMESTAMP '2024-02-15' GROUP BY 1""")
def range_presets(spark, d):
    _, first, last, _, grain = D.resolve_range("custom", "2023-11-01", "2024-05-01", dt.date(2024, 2, 14))
    rows = A.usage_series(table(spark, d, "usage"), f"{first} 00:00:00", f"{last + dt.timedelta(1)} 00:00:00", grain)
    return rows.select("bucket", "calls")


@query("prj04_effective_settings", "SELECT n_nationkey AS org, CASE WHEN s.k IS NULL OR n_nationkey % 3 = 0 THEN 'small' ELSE 'model-' || CAST(n_nationkey AS VARCHAR) END AS model, CASE WHEN s.k IS NULL OR n_nationkey % 5 = 0 THEN 8 ELSE n_nationkey % 5 END::INT AS top_k FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey % 2 = 0) s ON s.k = n_nationkey")
def settings(spark, d):
    k = F.col("s_nationkey")
    stored = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(k.alias("org")).distinct().select("org", F.when(F.col("org") % 3 == 0, "").otherwise(F.concat(F.lit("model-"), "org")).alias("model"), F.when(F.col("org") % 10 != 5, F.col("org") % 5).cast("int").alias("top_k"))
    return D.effective_settings(table(spark, d, "nation").select(F.col("n_nationkey").alias("org")), stored, "org", {"model": "small", "top_k": 8})


@query("join25_org_access", "SELECT n_nationkey AS org, min(c_mktsegment) AS role FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 20 = 7 GROUP BY 1")
def org_access(spark, d):
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("org"), (F.col("c_custkey") % 20).alias("user_id"), F.col("c_mktsegment").alias("role"))
    return D.org_access(table(spark, d, "nation").select(F.col("n_nationkey").alias("org")), members, "org", 7)


@query("join03_messages_of_conversations", duck("messages") + ", c AS (SELECT conv_id, min(created_at) AS started, count(*) AS n FROM messages GROUP BY 1) SELECT m.id, c.started, c.n FROM messages m JOIN c USING (conv_id) WHERE m.role = 'assistant' AND NOT m.is_eval AND c.started >= TIMESTAMP '2024-01-01 10:00:00'")
def messages(spark, d):
    m = table(spark, d, "messages")
    conversations = m.groupBy("conv_id").agg(F.min("created_at").alias("started"), F.count(F.lit(1)).alias("n"))
    rows = m.filter("role = 'assistant' and not is_eval").join(A.scoped(conversations, "2024-01-01 10:00:00", at="started"), "conv_id")
    return rows.select("id", "started", "n")


@query("set05_key_sets", "SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k")
def key_sets(spark, d):
    o = table(spark, d, "orders")
    return D.key_sets(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_custkey")


@query("hsh02_request_hash", "SELECT event_id, sha256('{\"request\":' || replace(props, ' ', '') || ',\"sample_idx\":' || CAST(event_id % 3 AS VARCHAR) || '}') AS h FROM events")
def request_hash(spark, d):
    python_ready(spark)
    return table(spark, d, "events").select("event_id", D.request_hash(F.col("props"), F.col("event_id") % 3).alias("h"))


@query("sta21_calibration_badges", """WITH c AS (SELECT o_orderkey AS id, 'm' || CAST(o_custkey % 40 AS VARCHAR) AS metric, o_orderkey % 4 AS pv, 'j' || CAST(o_custkey % 3 AS VARCHAR) AS jm, o_orderstatus AS status, o_orderkey % 6 AS n, o_totalprice AS kappa, o_orderdate AS made FROM orders WHERE o_orderkey % 6 > 0),
m AS (SELECT 'm' || CAST(i AS VARCHAR) AS metric, i % 5 > 0 AS live, i % 4 AS pv, 'j' || CAST(i % 3 AS VARCHAR) AS jm FROM range(60) t(i)),
e AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY metric, pv, jm ORDER BY made DESC, id DESC) = 1), l AS (SELECT metric, id AS latest FROM c QUALIFY row_number() OVER (PARTITION BY metric ORDER BY pv DESC, made DESC, id DESC) = 1)
SELECT m.metric, CASE WHEN live AND e.id IS NOT NULL THEN e.status WHEN live AND latest IS NOT NULL THEN 'stale' ELSE 'uncalibrated' END AS status, CASE WHEN live THEN coalesce(e.n, 0) ELSE 0 END AS n, CASE WHEN live THEN e.kappa END AS kappa, CASE WHEN live THEN e.id END AS calibration_id, CASE WHEN live AND e.id IS NULL THEN latest END AS latest_id
FROM m LEFT JOIN e ON e.metric = m.metric AND e.pv = m.pv AND e.jm = m.jm LEFT JOIN l ON l.metric = m.metric""")
def badges(spark, d):
    c = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), F.col("o_custkey") % 40).alias("metric"), (F.col("o_orderkey") % 4).alias("prompt_version"), F.concat(F.lit("j"), F.col("o_custkey") % 3).alias("judge_model"),
        F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 6).alias("n"), F.col("o_totalprice").alias("kappa"), F.col("o_orderdate").alias("created_at"),
    )
    m = spark.range(60)
    metrics = m.select(F.concat(F.lit("m"), "id").alias("metric"), (F.col("id") % 5 > 0).alias("reviewable"))
    targets = m.select(F.concat(F.lit("m"), "id").alias("metric"), (F.col("id") % 4).alias("prompt_version"), F.concat(F.lit("j"), F.col("id") % 3).alias("judge_model"))
    return D.badges(metrics, targets, c)


@query("srt12_disagreement_sample", """WITH s AS (SELECT l_orderkey AS k, max(l_discount) AS score FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1), t AS (SELECT k, score FROM s WHERE score > 0 ORDER BY score DESC, sha256('7' || chr(31) || 'tie' || chr(31) || CAST(k AS VARCHAR)), k LIMIT 50)
SELECT k, score, CAST(row_number() OVER (ORDER BY sha256('7' || chr(31) || 'deal' || chr(31) || CAST(k AS VARCHAR)), k) AS INT) AS pos FROM t""")
def disagreement(spark, d):
    scores = table(spark, d, "lineitem").filter("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_discount").alias("score"))
    return D.disagreement_sample(scores, "k", "score", 50, 7)


_VERSIONS = """v AS (SELECT o_custkey AS dataset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, CASE WHEN o_custkey % 3 = 0 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 THEN 'draft' ELSE 'published' END AS status, o_orderkey FROM orders),
cases AS (SELECT dataset_id, version, l_linenumber AS position, l_partkey AS part, l_quantity::INT AS quantity FROM v JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey % 4 > 0)"""


def _versions(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))) == 1
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id"), n.cast("long").alias("version"), F.when((F.col("o_custkey") % 3 == 0) & last, "draft").otherwise("published").alias("status"), "o_orderkey")
    li = table(spark, d, "lineitem").filter("l_partkey % 4 > 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"))
    return v.drop("o_orderkey"), v.join(li, "o_orderkey").select("dataset_id", "version", "position", "part", "quantity")


@query("sta37_new_versions", f"""WITH {_VERSIONS}, s AS (SELECT dataset_id, max(version) AS latest, max(CASE WHEN status = 'draft' THEN version END) AS draft FROM v GROUP BY 1)
SELECT dataset_id, latest + 1 AS version, 'draft' AS kind, NULL::BIGINT AS part FROM s WHERE draft IS NULL UNION ALL SELECT c.dataset_id, latest + 1, 'case', part FROM cases c JOIN s ON s.dataset_id = c.dataset_id AND draft IS NULL AND c.version = latest UNION ALL SELECT dataset_id, draft, 'refused', NULL FROM s WHERE draft IS NOT NULL""")
def new_versions(spark, d):
    drafts, copied, refused = D.new_versions(*_versions(spark, d))
    row = lambda df, kind, part: df.select("dataset_id", "version", F.lit(kind).alias("kind"), part.cast("long").alias("part"))
    return row(drafts, "draft", F.lit(None)).unionByName(row(copied, "case", F.col("part"))).unionByName(row(refused, "refused", F.lit(None)))


@query("sta37_published_versions", f"""WITH {_VERSIONS}, h AS (SELECT dataset_id, version, sha256('{{"part":' || CAST(part AS VARCHAR) || ',"quantity":' || CAST(quantity AS VARCHAR) || '}}') AS h FROM cases),
g AS (SELECT dataset_id, version, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS hash FROM h GROUP BY 1, 2)
SELECT dataset_id, version, CASE WHEN status = 'draft' AND n IS NULL THEN 'draft' ELSE 'published' END AS status, coalesce(n, 0) AS case_count, hash AS content_hash FROM v LEFT JOIN g USING (dataset_id, version)""")
def published(spark, d):
    return D.published(*_versions(spark, d), ["quantity", "part"])


def _chunks(spark, d):
    """Documents as chunks: a title of three words, a section number, a department and a country."""
    k = F.col("doc_id")
    words = F.split(F.lit("leave travel pay safety training privacy notice overtime"), " ")
    word = lambda n: F.element_at(words, (F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(8)) + 1).cast("int"))
    cite = F.concat(F.lit(" see AB-CD-"), F.lpad((k * 7 % 30).cast("string"), 3, "0"), F.lit(" "))
    return table(spark, d, "documents").select(
        k.alias("chunk_id"), F.concat(F.lit("AB-CD-"), F.lpad((k % 30).cast("string"), 3, "0")).alias("doc_code"), k.cast("int").alias("chunk_index"), F.concat((k % 9).cast("string"), F.lit("."), (k % 4).cast("string")).alias("section_number"),
        F.concat_ws(" ", word(1), F.lit("Policy"), word(2)).alias("section_title"), (k % 9).cast("string").alias("top_section"), F.concat(F.lit("dep"), k % 2).alias("department"), F.when(k % 30 < 12, F.element_at(F.array(*map(F.lit, ("DE", "GB", "US"))), (k % 30 % 3 + 1).cast("int"))).alias("jurisdiction"),
        (k % 30 < 12).alias("supplement"), F.when(k % 17 == 0, "glossary").otherwise("prose").alias("content_type"), (F.col("n_chars") / 4).cast("int").alias("tokens"), F.concat(F.coalesce("text", F.lit("")), F.when(k % 5 == 0, cite).otherwise("")).alias("text"),
    )


ANGLES, THEMES = ["a missing number", "another country", "a later version"], ["cooking", "sport"]
COUNTS = {"single_hop": 12, "multi_hop": 10, "jurisdiction": 8, "comparative": 6, "unanswerable": 5, "out_of_scope": 3}


@query("sta28_seed_samples")
def seed_samples(spark, d):
    """Seeds of every type; tests hold quotas, pairs and order to plain Python."""
    return seeds.sample_seeds(_chunks(spark, d), COUNTS, 11, ANGLES, THEMES)[0]


# --- retrieval lists and what stood without an operator


@query("ret03_run_lists")
def run_lists(spark, d):
    """Every question's lists: unfiltered, one department, and documents of its own, by both methods; tests hold them to plain Python."""
    e = table(spark, d, "embeddings")
    none = F.lit(None)
    f = lambda dep, docs: F.struct(dep.cast("array<string>").alias("departments"), docs.cast("array<long>").alias("documents"))
    dep = F.array(F.concat(F.lit("src"), F.col("item_id") % 25))
    filters = F.when(F.col("item_id") % 3 == 0, F.array(f(none, none))).when(F.col("item_id") % 3 == 1, F.array(f(dep, none), f(none, F.sequence(F.lit(0), F.lit(40))))).otherwise(F.array(f(dep, F.sequence(F.lit(0), F.lit(90)))))
    parts = table(spark, d, "benchmark").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id", "left")
    parts = parts.select(F.col("item_id").alias("query"), F.lit(0).alias("part"), "text", "vector", filters.alias("filters"))
    chunks = table(spark, d, "documents").join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    chunks = chunks.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("document"), F.col("source").alias("department"), "text", "vector")
    return R.run_lists(parts, chunks)


@query("ret12_numbered_sources")
def numbered_sources(spark, d):
    """The whole way of a question: lists by parts, filters and methods, fused, boosted, and chosen greedily within its limits as numbered sources."""
    docs = table(spark, d, "docs")
    fused = R.rrf(run_lists(spark, d), "query", "key").withColumnRenamed("key", "doc_id")
    hits = F.broadcast(fused) if fused.count() <= 500_000 else fused  # a question has some dozen rows; texts are not exchanged for them
    fused = hits.join(docs.select("doc_id", "jurisdiction", "doc_type", "n_chars", "text"), "doc_id")
    factor = R.jurisdiction_factor(F.lit(None).cast("string"), F.upper("jurisdiction"), F.col("doc_type"))
    best = R.ranked(fused.withColumn("score", F.col("score") * factor), "query", F.desc(F.round("score", 12)), "doc_id", 30)
    rows = best.select(
        "query", "rank", F.col("doc_id").alias("chunk"), F.floor(F.col("doc_id") / 10).alias("document"), (F.col("doc_id") % 10).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"), F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).alias("tokens"),
        F.when(F.col("doc_id") % 7 == 0, "table").otherwise("prose").alias("content_type"), F.lit("").alias("section"),
    )
    return R.select_sources(rows, "query", *R.source_limits(1))


@query("ret01_bm25_search_tokens")
def search_tokens(spark, d):
    """BM25 over the index's own tokens: normalised, stemmed, compounds in parts; tests hold it to plain Python."""
    index = _indexed(spark, table(spark, d, "documents"), T.search_tokens)
    return BI.search(index, R.query_terms(table(spark, d, "benchmark"), "item_id", "text"), "item_id", "doc_id")


@query("ret14_filters_of_routes", "SELECT o_orderkey AS k, 'a' AS filter FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, 'documents 1,2' FROM orders WHERE o_custkey % 3 = 1 UNION ALL SELECT o_orderkey, 'free' FROM orders WHERE o_custkey % 3 = 2")
def filters_of_routes(spark, d):
    dep = F.when(F.col("o_custkey") % 3 == 2, F.array()).otherwise(F.array(F.lit("a"), F.lit("b"))).cast("array<string>")
    docs = F.when(F.col("o_custkey") % 3 == 1, F.array(F.lit(1), F.lit(2))).cast("array<long>")
    rows = R.search_filters(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), dep.alias("departments"), docs.alias("documents")))
    shown = F.when(F.col("filter.documents").isNotNull(), F.concat(F.lit("documents "), F.array_join(F.transform("filter.documents", lambda x: x.cast("string")), ","))).when(F.col("filter.departments").isNotNull(), F.array_join("filter.departments", ",")).otherwise("free")
    return rows.select("k", shown.alias("filter"))


@query("ret10_limits_by_parts", "WITH p AS (SELECT o_orderkey, o_custkey % 12 + 1 AS p FROM orders) SELECT o_orderkey, CASE WHEN p = 1 THEN 8 ELSE least(greatest(8, 2 * p), 16) END AS top_k, CASE WHEN p = 1 THEN 6000 ELSE least(greatest(6000, 1500 * p), 12000) END AS budget FROM p")
def limits_by_parts(spark, d):
    k, b = R.limits_of(F.col("o_custkey") % 12 + 1)
    return table(spark, d, "orders").select("o_orderkey", k.alias("top_k"), b.alias("budget"))


@query("arr01_common_prefixes", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || '/b' WHEN 1 THEN o_orderpriority ELSE '' END AS p FROM orders")
def prefixes(spark, d):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 3
    path = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    paths = F.when(k == 0, F.array(path(p, "b", "c"), path(p, "b"), path(p, "b", "d"))).when(k == 1, F.array(path(p, "x"), path(p, "y", "z"))).otherwise(F.array(path(p), path("other")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.common_prefix(paths), "/").alias("p"))


@query("mth06_estimates_of_runs", duck("run_scores") + " SELECT run, count(*) AS cases, round(count(*) * 0.0012 + count(*) * 3 * 0.003, 6)::DOUBLE AS usd FROM run_scores GROUP BY 1")
def estimates(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "run_scores").groupBy("run").agg(n.alias("cases"), E.cost_of(n, F.lit(3)).alias("usd"))


@query("agg17_chunks_of_documents", "SELECT o_orderkey, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def chunks_of_documents(spark, d):
    return E.chunk_counts(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("doc16_edited_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN o_orderkey % 4 = 0 THEN 'edited' ELSE o_orderpriority END AS title, o_clerk AS owner, o_orderkey % 4 = 0 AS reindex FROM lineitem JOIN (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS o_clerk FROM orders) o ON o_orderkey = l_orderkey")
def edited_columns(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("owner"))
    edits = o.filter("k % 2 = 0").select("k", F.when(F.col("k") % 4 == 0, "edited").alias("title"), F.lit("new").alias("owner"))
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_quantity")
    return E.synced(chunks, o, edits, "k", ["title", "owner"], ["title"]).withColumnRenamed("k", "l_orderkey")


@query("sta35_committed_cases", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus = 'F' AND o_orderkey % 4 > 0 AND NOT EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o_custkey AND c_custkey % 2 = 0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def committed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("status"), (F.col("o_orderkey") % 4 == 0).alias("committed"))
    existing = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return E.committed(o, existing, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query("sta02_summaries", duck("run_scores") + " SELECT run, count(*) AS n, avg(latency_ms) AS mean, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, avg((hit >= 0.5)::INT) AS pass_rate FROM run_scores WHERE status = 'done' GROUP BY 1", ("mean", "p50", "p95"))
def summaries(spark, d):
    return E.summaries(table(spark, d, "run_scores").filter("status = 'done'"), "run", "latency_ms", F.col("hit") >= 0.5)
