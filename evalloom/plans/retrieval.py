"""Retrieval queries: documents as chunks, benchmark texts as questions, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions import text as T
from evalloom.operators import block_index as BI
from evalloom.operators import retrieval as R
from evalloom.operators import vector_cells as V
from evalloom.plans.registry import query
from evalloom.sources import snapshots
from evalloom.sources.session import shared_place, shuffle_partitions
from evalloom.sources.standins import table

_TOK = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 1)"
_BM25 = f"""
tok AS (SELECT doc_id, source, {_TOK} AS t FROM documents),
each AS (SELECT doc_id, source, unnest(t) AS term FROM tok),
stats AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tok),
terms AS (SELECT DISTINCT item_id, unnest({_TOK}) AS term FROM benchmark),
tf AS (SELECT doc_id, source, term, count(*) AS tf FROM each GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT item_id, tf.doc_id, tf.source, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / al))) AS score
    FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN tok USING (doc_id), stats GROUP BY ALL)"""


def _questions(spark, d):
    return table(spark, d, "benchmark")


def _terms(questions):
    return R.query_terms(questions, "item_id", "text", T.simple_tokens)


def _indexed(spark, docs, tokens, keep=()):
    """An index of the documents: each text is cut into tokens once, and all that follows reads postings."""
    path = shared_place(spark)
    BI.write(docs, path, "doc_id", "doc_id", "text", tokens, keep, buckets=shuffle_partitions(spark))
    return snapshots.read(spark, path)


def _bm25(spark, d, allowed=None):
    index = _indexed(spark, table(spark, d, "documents"), T.simple_tokens, ("source", "lang"))
    return BI.search(index, _terms(_questions(spark, d)), "item_id", "doc_id", 30, allowed)


def _shown(rows):
    return rows.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_TOP = "row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)"


@query("ret01_bm25_top_k", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, {_TOP} AS rank FROM scored) WHERE rank <= 30")
def bm25(spark, d):
    return _shown(_bm25(spark, d))


@query("ret01_bm25_top_k_all")
def bm25_all(spark, d):
    return bm25(spark, d)


@query("ret01_bm25_filtered", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, {_TOP} AS rank FROM scored WHERE source = 'src3') WHERE rank <= 30")
def bm25_filtered(spark, d):
    return _shown(_bm25(spark, d, F.col("source") == "src3"))


@query("ret01_bm25_filtered_all")
def bm25_filtered_all(spark, d):
    return bm25_filtered(spark, d)


@query("ret01_bm25_unindexed", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM scored WHERE source = 'src3' AND lang = 'fr'".replace("tok AS (SELECT doc_id, source,", "tok AS (SELECT doc_id, source, lang,").replace("tf.source,", "tf.source, lang,"))
def bm25_unindexed(spark, d):
    """Scores of every document of a filter, by joins over its tokens: what the index's lists are cut from."""
    docs = table(spark, d, "documents")
    scores = R.bm25_scores(_terms(_questions(spark, d)), docs, "item_id", "doc_id", "text", docs.filter("source = 'src3' AND lang = 'fr'").select("doc_id"), T.simple_tokens)
    return scores.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("ret01_blocks_read")
def blocks_read(spark, d):
    """How many blocks the questions met in each segment, and how many were unpacked."""
    index = _indexed(spark, table(spark, d, "documents"), T.simple_tokens)
    return BI.search(index, _terms(_questions(spark, d)), "item_id", "doc_id", 30, counts=True)


@query("agg18_corpus_stats", f"SELECT count(*) AS n, round(coalesce(avg(len({_TOK})), 0), 6) AS avg_length FROM documents")
def stats(spark, d):
    return R.corpus_stats(table(spark, d, "documents"), "doc_id", "text", T.simple_tokens).select("n", F.round("avg_length", 6).alias("avg_length"))


@query("agg21_term_frequencies", f"SELECT doc_id, term, count(*) AS tf, max(l) AS length FROM (SELECT doc_id, unnest(t) AS term, len(t) AS l FROM (SELECT doc_id, {_TOK} AS t FROM documents)) GROUP BY doc_id, term")
def term_frequencies(spark, d):
    return R.postings(table(spark, d, "documents"), "doc_id", "text", T.simple_tokens).select("doc_id", "term", "tf", "length")


_COS = """cos AS (SELECT q.vec_id AS q, v.vec_id, v.label, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""


@query("ret02_cosine_top_k", f"WITH {_COS} SELECT q, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, vec_id) AS rank FROM cos) WHERE rank <= 30")
def cosine(spark, d):
    return _cosine(table(spark, d, "embeddings")).select("q", "vec_id", F.round("score", 6).alias("score"), "rank")


def _cosine(e, keep=(), allowed=None):
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return V.cosine_lists(queries, e, "q", "qv", "vec_id", "embedding", keep=keep, allowed=allowed)


@query("ret02_cosine_filtered", f"WITH {_COS} SELECT q, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, vec_id) AS rank FROM cos WHERE label IN (2, 7)) WHERE rank <= 30")
def cosine_filtered(spark, d):
    """The filter stands inside the search: lists are full as long as enough vectors pass."""
    rows = _cosine(table(spark, d, "embeddings"), ("label",), lambda m: m["label"].isin(2, 7))
    return rows.select("q", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("ret02_pairs_scored")
def pairs_scored(spark, d):
    """How many pairs of queries and vectors there are, and how many were scored."""
    e, path = table(spark, d, "embeddings"), shared_place(spark)
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return V.search(spark, path, V.write(e, path, "vec_id", "embedding"), queries, "q", "qv", "vec_id", counts=True)


@query("ret02_cosine_unindexed", f"WITH {_COS} SELECT q, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, vec_id) AS rank FROM cos) WHERE rank <= 5")
def cosine_unindexed(spark, d):
    """The same lists, shorter, by scoring every pair in blocks of queries."""
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return R.cosine_top_k(queries, e, "q", "qv", "vec_id", "embedding", 5).select("q", "vec_id", F.round("score", 6).alias("score"), "rank")


def _lexical(spark, d, allowed=None):
    return _bm25(spark, d, allowed).select(F.col("item_id").alias("q"), F.col("doc_id").alias("vec_id"), "rank", F.lit("bm25").alias("method"))


def _lists(spark, d):
    """Two ranked lists of each question: BM25 over the documents, and cosine over the documents' vectors where the question has one."""
    e = table(spark, d, "embeddings")
    asked = _questions(spark, d).select(F.col("item_id").alias("q")).join(e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), "q")
    dense = V.cosine_lists(asked, e, "q", "qv", "vec_id", "embedding").select("q", "vec_id", "rank", F.lit("vector").alias("method"))
    return dense.unionByName(_lexical(spark, d))


_LISTS = f"""WITH {_BM25}, lex AS (SELECT item_id AS q, doc_id AS vec_id, rank, 'bm25' AS method FROM (SELECT *, {_TOP} AS rank FROM scored) WHERE rank <= 30),
{_COS.replace("FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0", "FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v")},
dense AS (SELECT q, vec_id, rank, 'vector' AS method FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, vec_id) AS rank FROM cos) WHERE rank <= 30),
lists AS (SELECT * FROM dense UNION ALL SELECT * FROM lex),
fused AS (SELECT q, vec_id, sum(CASE method WHEN 'bm25' THEN 0.6 ELSE 1.0 END::DOUBLE / (60 + rank)) AS score, min(CASE WHEN method = 'bm25' THEN rank END) AS bm25_rank, min(CASE WHEN method = 'vector' THEN rank END) AS vector_rank FROM lists GROUP BY 1, 2)"""


@query("ret05_rrf_fusion", _LISTS + " SELECT q, vec_id, round(score, 9) AS score, CAST(bm25_rank AS INT) AS bm25_rank, CAST(vector_rank AS INT) AS vector_rank FROM fused")
def fusion(spark, d):
    return R.rrf(_lists(spark, d), "q", "vec_id").select("q", "vec_id", F.round("score", 9).alias("score"), "bm25_rank", "vector_rank")


@query("ret05_rrf_fusion_all")
def fusion_all(spark, d):
    return fusion(spark, d)


@query("ret06_jurisdiction_boost", _LISTS + """
, j AS (SELECT f.q, f.vec_id, f.score * CASE WHEN f.q % 5 = 0 THEN CASE WHEN f.vec_id % 6 = 0 THEN 0.9 ELSE 1.0 END WHEN lang = 'en' THEN 1.0 WHEN lang = 'de' THEN 1.25 ELSE 0.8 END::DOUBLE AS score FROM fused f JOIN documents d ON d.doc_id = f.vec_id)
SELECT q, vec_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, vec_id) AS INT) AS rank FROM j""")
def boost(spark, d):
    docs = table(spark, d, "docs").select(F.col("doc_id").alias("vec_id"), F.when(F.col("jurisdiction") == "en", "GLOBAL").otherwise(F.upper("jurisdiction")).alias("j"), "doc_type")
    fused = R.rrf(_lists(spark, d), "q", "vec_id").join(docs, "vec_id")
    target = F.when(F.col("q") % 5 != 0, "DE")
    rows = fused.withColumn("score", F.col("score") * R.jurisdiction_factor(target, F.col("j"), F.col("doc_type")))
    return R.ranked(rows, "q", F.desc(F.round("score", 12)), "vec_id", 1000).select("q", "vec_id", F.round("score", 9).alias("score"), "rank")


@query("ret06_jurisdiction_boost_all")
def boost_all(spark, d):
    return boost(spark, d)


@query("ret04_sparse_fallback", f"""WITH {_BM25.replace("tok AS (SELECT doc_id, source,", "tok AS (SELECT doc_id, source, lang,").replace("tf.source,", "tf.source, lang,")},
f AS (SELECT item_id AS q, doc_id AS vec_id FROM (SELECT *, {_TOP} AS rank FROM scored WHERE source = 'src3' AND lang = 'fr') WHERE rank <= 30), u AS (SELECT item_id AS q, doc_id AS vec_id FROM (SELECT *, {_TOP} AS rank FROM scored) WHERE rank <= 30),
few AS (SELECT q FROM (SELECT DISTINCT q FROM u) LEFT JOIN (SELECT q, count(*) AS n FROM f GROUP BY q) USING (q) WHERE coalesce(n, 0) < 3)
SELECT q, vec_id, false AS fallback FROM f UNION ALL SELECT q, vec_id, true FROM u WHERE q IN (SELECT q FROM few)""")
def fallback(spark, d):
    """BM25 lists of one department's French documents; questions with fewer than three hits also get their list over all."""
    index = _indexed(spark, table(spark, d, "documents"), T.simple_tokens, ("source", "lang"))
    of = lambda allowed: BI.search(index, _terms(_questions(spark, d)), "item_id", "doc_id", 30, allowed).select(F.col("item_id").alias("q"), F.col("doc_id").alias("vec_id"))
    return R.with_fallback(of((F.col("source") == "src3") & (F.col("lang") == "fr")), of(None), "q")


@query("ret04_sparse_fallback_all")
def fallback_all(spark, d):
    return fallback(spark, d)


@query("ret16_mode_switch", _LISTS + """, m AS (SELECT * FROM (VALUES ('hybrid', 'bm25'), ('hybrid', 'vector'), ('bm25', 'bm25'), ('vector', 'vector')) t(mode, method)),
s AS (SELECT mode, q, vec_id, sum(CASE method WHEN 'bm25' THEN 0.6 ELSE 1.0 END::DOUBLE / (60 + rank)) AS score FROM lists JOIN m USING (method) GROUP BY ALL)
SELECT mode, q, vec_id, CAST(row_number() OVER (PARTITION BY mode, q ORDER BY round(score, 12) DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 8""")
def modes(spark, d):
    """The first eight of every question in each mode: both methods fused, or one alone."""
    return R.in_modes(_lists(spark, d), "q", "vec_id", 8)


@query("ret16_mode_switch_all")
def modes_all(spark, d):
    return modes(spark, d)


@query("ret10_source_limits", "WITH p AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS parts FROM conversations GROUP BY 1) SELECT conv_id, parts, CASE WHEN parts <= 1 THEN 8 ELSE least(greatest(8, 2 * parts), 16) END::INT AS top_k, CASE WHEN parts <= 1 THEN 6000 ELSE least(greatest(6000, 1500 * parts), 12000) END::INT AS budget FROM p")
def limits(spark, d):
    """A conversation's questions as the parts of one."""
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("parts"))
    k, b = R.limits_of(F.col("parts"))
    return parts.select("conv_id", "parts", k.cast("int").alias("top_k"), b.cast("int").alias("budget"))


@query("ret08_select_sources")
def select_sources(spark, d):
    """The greedy walk over the BM25 lists; tests hold it against plain Python."""
    docs = table(spark, d, "documents")
    hits = BI.search(_indexed(spark, docs, T.search_tokens), R.query_terms(_questions(spark, d), "item_id", "text"), "item_id", "doc_id", 30)
    chunks = docs.select("doc_id", "text", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    rows = hits.join(chunks, "doc_id").select("item_id", "rank", F.col("doc_id").alias("chunk"), (F.col("doc_id") / 10).cast("long").alias("document"), (F.col("doc_id") % 10).alias("chunk_index"), "text", "tokens", F.lit("prose").alias("content_type"), F.lit("").alias("section"))
    return R.select_sources(rows, "item_id")


@query("ret12_hybrid_retrieval")
def hybrid(spark, d):
    """BM25 and cosine lists over documents with vectors, fused, boosted, ordered and cut to the budget."""
    docs = table(spark, d, "docs")
    e = table(spark, d, "embeddings")
    questions = _questions(spark, d)
    lexical = BI.search(_indexed(spark, docs, T.search_tokens), R.query_terms(questions, "item_id", "text"), "item_id", "doc_id").select("item_id", "doc_id", "rank", F.lit("bm25").alias("method"))
    vectors = questions.select("item_id").join(e.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    dense = V.cosine_lists(vectors, e, "item_id", "embedding", "vec_id", "embedding").select("item_id", F.col("vec_id").alias("doc_id"), "rank", F.lit("vector").alias("method"))
    fused = R.rrf(lexical.unionByName(dense), "item_id", "doc_id").join(docs.select("doc_id", "jurisdiction", "doc_type", "n_chars"), "doc_id")
    factor = R.jurisdiction_factor(F.lit(None).cast("string"), F.upper("jurisdiction"), F.col("doc_type"))
    out = R.ranked(fused.withColumn("score", F.col("score") * factor), "item_id", F.desc("score"), "doc_id", 8)
    return out.select("item_id", F.col("rank").alias("n"), "doc_id", F.round("score", 6).alias("score"), "bm25_rank", "vector_rank")


@query("srt01_top_k_ties", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 30")
def top_ties(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(30).select("event_id", "value")


@query("win07_average_ranks", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0 AS r FROM orders")
def average_ranks(spark, d):
    o = table(spark, d, "orders")
    rank = F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority"))
    return o.select("o_orderkey", (rank + (ties - 1) / 2.0).alias("r"))
