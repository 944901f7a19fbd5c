"""Seeds of synthetic cases: chunks drawn by type under quotas, with seeded hashes in place of a random generator.

Quotas follow the largest-remainder rule; every draw is an order by a hash of
the seed and the row, so it does not depend on partitions. Chunks that nothing
has drawn yet come first within a type; between types chunks may repeat.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions import text as T
from evalloom.operators.evaluation import topic_words
from evalloom.operators.statistics import allocate, weighted_draw

TYPES = ("single_hop", "multi_hop", "jurisdiction", "comparative", "unanswerable", "out_of_scope")
LEAST_TOKENS = 80
EXCLUDED = ("revision_history", "glossary")


def eligible(chunks: DataFrame) -> DataFrame:
    """Chunks with a section number, a code, ``LEAST_TOKENS`` tokens and a content type that has something to ask."""
    return chunks.filter((F.coalesce("section_number", F.lit("")) != "") & (F.coalesce("doc_code", F.lit("")) != "") & (F.col("tokens") >= LEAST_TOKENS) & ~F.col("content_type").isin(*EXCLUDED))


def draw(seed: int, *columns) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]), 256)


def allocated(weights: DataFrame, key: str, weight: str, count: int, seed: int) -> DataFrame:
    """(key, quota): ``count`` dealt by :func:`allocate`; with fewer than one for each key, so many keys drawn by weight."""
    keys = weights.filter(F.col(weight) > 0)
    if count <= 0:
        return keys.limit(0).select(key, F.lit(0).cast("long").alias("quota"))
    if keys.count() > count:
        return weighted_draw(keys, key, weight, count, seed).select(key, F.lit(1).cast("long").alias("quota"))
    return allocate(keys, key, weight, count).select(key, F.col("n").alias("quota"))


def _dealt(pool: DataFrame, quotas: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first rows of each key by ``order``, as many as its quota."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return pool.join(quotas, key).withColumn("_nth", nth).filter(F.col("_nth") <= F.col("quota"))


def _seed_rows(rows: DataFrame, kind: str, first: Column, second: Column, hint: Column, order: list[Column]) -> DataFrame:
    ids = F.filter(F.array(first.cast("string"), second.cast("string")), lambda c: c.isNotNull())
    return rows.select(F.lit(kind).alias("type"), ids.alias("chunk_ids"), hint.alias("hint"), F.row_number().over(Window.orderBy(*order)).alias("n"))


def single_hop(chunks: DataFrame, count: int, seed: int) -> DataFrame:
    quotas = allocated(chunks.groupBy("doc_code").agg(F.count(F.lit(1)).alias("w")), "doc_code", "w", count, seed)
    rows = _dealt(chunks.select("doc_code", "chunk_id"), quotas, "doc_code", [draw(seed, F.lit("single"), "chunk_id")])
    return _seed_rows(rows, "single_hop", F.col("chunk_id"), F.lit(None), F.lit(None).cast("string"), [F.col("doc_code"), F.col("_nth")])


def cross_document_pairs(chunks: DataFrame) -> DataFrame:
    """(a, b): each chunk that names another document's code with the chunk there that shares most words (ties: the first)."""
    words = F.array_except(T.simple_tokens(F.col("text")), F.array(*map(F.lit, T.STOPWORDS)))
    base = chunks.select("chunk_id", "doc_code", "chunk_index", words.alias("_w"), F.array_distinct(F.regexp_extract_all("text", F.lit(f"({T.DOC_CODE})"), F.lit(1))).alias("_codes"))
    a = base.select(F.col("chunk_id").alias("a"), F.col("doc_code").alias("_own"), F.col("_w").alias("_wa"), F.explode("_codes").alias("doc_code")).filter(F.col("doc_code") != F.col("_own"))
    both = a.join(base.select("doc_code", F.col("chunk_id").alias("b"), F.col("chunk_index").alias("_i"), "_w"), "doc_code")
    shared = F.size(F.array_intersect("_wa", "_w"))
    return both.groupBy("a", "doc_code").agg(F.min(F.struct((-shared).alias("s"), F.col("_i").alias("i"), F.col("b").alias("b"))).alias("x")).select("a", F.col("x.b").alias("b"))


def multi_hop(chunks: DataFrame, count: int, seed: int) -> DataFrame:
    """At most half of the seeds cross documents; the others pair two sections of one document, of one part if it has two."""
    half = count // 2
    crossed = cross_document_pairs(chunks).orderBy(draw(seed, F.lit("cross"), "a", "b"), "a", "b").limit(half)
    cross = _seed_rows(crossed, "multi_hop", F.col("a"), F.col("b"), F.lit("cross_document"), [draw(seed, F.lit("cross"), "a", "b"), F.col("a")])
    rest = count - crossed.count()  # at most half the seeds were asked for
    weights = chunks.groupBy("doc_code").agg(F.count(F.lit(1)).alias("w"), F.countDistinct("section_number").alias("s")).filter("s > 1").drop("s")
    firsts = _dealt(chunks.select("doc_code", "chunk_id", "section_number", "top_section"), allocated(weights, "doc_code", "w", rest, seed + 1), "doc_code", [draw(seed, F.lit("first"), "chunk_id")])
    other = chunks.select("doc_code", F.col("chunk_id").alias("b"), F.col("section_number").alias("_s"), F.col("top_section").alias("_t"))
    pairs = firsts.join(other, "doc_code").filter(F.col("section_number") != F.col("_s"))
    best = F.min(F.struct((~F.col("top_section").eqNullSafe(F.col("_t"))).alias("far"), draw(seed, F.lit("second"), "chunk_id", "b").alias("h"), F.col("b").alias("b")))
    same = pairs.groupBy("doc_code", "_nth", "chunk_id").agg(best.alias("x"))
    same = _seed_rows(same, "multi_hop", F.col("chunk_id"), F.col("x.b"), F.lit("same_document"), [F.col("doc_code"), F.col("_nth")])
    return cross.unionByName(same.withColumn("n", F.col("n") + half))


def title_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(department, a_key, b_key): each section of ``a`` with the sections of ``b`` of its department whose titles match it best.

    Both have department, key and title. Candidates share a topic word; at least
    half of the shorter title's words must be shared, the higher (containment,
    Jaccard) wins, ties stay.
    """
    wa = a.select("department", F.col("key").alias("a_key"), topic_words(F.col("title")).alias("_wa"))
    wb = b.select("department", F.col("key").alias("b_key"), topic_words(F.col("title")).alias("_wb"))
    both = wa.withColumn("_t", F.explode("_wa")).join(wb.withColumn("_t", F.explode("_wb")), ["department", "_t"]).dropDuplicates(["department", "a_key", "b_key"])
    shared = F.size(F.array_intersect("_wa", "_wb"))
    score = F.struct((shared / F.least(F.size("_wa"), F.size("_wb"))).alias("c"), (shared / F.size(F.array_union("_wa", "_wb"))).alias("j"))
    rank = F.rank().over(Window.partitionBy("department", "a_key").orderBy(F.desc("_score")))
    return both.withColumn("_score", score).filter("_score.c >= 0.5").withColumn("_r", rank).filter("_r = 1").select("department", "a_key", "b_key")


def _sections(chunks: DataFrame, seed: int, tag: str) -> DataFrame:
    """One row for each numbered section: its key, title and a seeded chunk of it."""
    body = chunks.filter(F.col("section_number").rlike("^[0-9]")).withColumn("key", F.concat_ws(" §", "doc_code", "section_number"))
    return body.groupBy("key", "department", "jurisdiction").agg(F.min_by("section_title", "chunk_index").alias("title"), F.min_by("chunk_id", draw(seed, F.lit(tag), "chunk_id")).alias("chunk"))


def jurisdiction(chunks: DataFrame, count: int, seed: int) -> DataFrame:
    """Pairs of a company-wide section and a country supplement's section on the same topic, dealt over countries."""
    local, base = _sections(chunks.filter("supplement"), seed, "local"), _sections(chunks.filter("not supplement"), seed, "base")
    pairs = title_matches(local, base).join(local.select(F.col("key").alias("a_key"), "jurisdiction", F.col("chunk").alias("_la")), "a_key").join(base.select(F.col("key").alias("b_key"), F.col("chunk").alias("_lb")), "b_key")
    pairs = pairs.withColumn("jurisdiction", F.coalesce("jurisdiction", F.lit("?")))
    quotas = allocated(pairs.groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("w")), "jurisdiction", "w", count, seed)
    rows = _dealt(pairs, quotas, "jurisdiction", [draw(seed, F.lit("jur"), "a_key", "b_key")])
    return _seed_rows(rows, "jurisdiction", F.col("_lb"), F.col("_la"), F.col("jurisdiction"), [F.col("jurisdiction"), F.col("_nth")])


def comparative(chunks: DataFrame, count: int, seed: int) -> DataFrame:
    """Pairs of two countries' sections on the same topic, dealt over pairs of countries."""
    local = _sections(chunks.filter("supplement"), seed, "local").withColumn("jurisdiction", F.coalesce("jurisdiction", F.lit("?")))
    words = local.select("department", "jurisdiction", "key", "chunk", topic_words(F.col("title")).alias("_w"))
    left = words.select("department", F.col("jurisdiction").alias("ja"), F.col("key").alias("ka"), F.col("chunk").alias("ca"), F.col("_w").alias("wa"), F.explode("_w").alias("_t"))
    right = words.select("department", F.col("jurisdiction").alias("jb"), F.col("key").alias("kb"), F.col("chunk").alias("cb"), F.col("_w").alias("wb"), F.explode("_w").alias("_t"))
    both = left.join(right, ["department", "_t"]).filter("ja < jb").dropDuplicates(["ka", "kb"])
    shared = F.size(F.array_intersect("wa", "wb"))
    score = F.struct((shared / F.least(F.size("wa"), F.size("wb"))).alias("c"), (shared / F.size(F.array_union("wa", "wb"))).alias("j"))
    rank = F.rank().over(Window.partitionBy("ka", "jb").orderBy(F.desc("_score")))
    pairs = both.withColumn("_score", score).filter("_score.c >= 0.5").withColumn("_r", rank).filter("_r = 1").withColumn("pair", F.concat_ws("|", "ja", "jb"))
    quotas = allocated(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("w")), "pair", "w", count, seed)
    rows = _dealt(pairs, quotas, "pair", [draw(seed, F.lit("cmp"), "ka", "kb")])
    return _seed_rows(rows, "comparative", F.col("ca"), F.col("cb"), F.col("pair"), [F.col("pair"), F.col("_nth")])


def hinted(chunks: DataFrame, kind: str, count: int, options: list[str], seed: int) -> DataFrame:
    """Seeds without chunks: the options in a seeded order, over and over."""
    order = chunks.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, options))).alias("o")).select("o", (F.row_number().over(Window.orderBy(draw(seed, F.lit(kind), "o"))) - 1).alias("i"))
    rows = chunks.sparkSession.range(count).join(order, F.col("id") % len(options) == F.col("i"))
    return rows.select(F.lit(kind).alias("type"), F.array().cast("array<string>").alias("chunk_ids"), F.col("o").alias("hint"), (F.col("id") + 1).cast("int").alias("n"))


def sample_seeds(chunks: DataFrame, counts: dict[str, int], seed: int, angles: list[str], themes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(seeds, shortfall): seeds (pos, type, chunk_ids, hint, n) of every requested type dealt in turn, and what each type lacks.

    ``chunks``: chunk_id, doc_code, chunk_index, section_number, section_title,
    top_section, department, jurisdiction, supplement, content_type, tokens, text.
    """
    pool = eligible(chunks)
    make = {
        "single_hop": single_hop, "multi_hop": multi_hop, "jurisdiction": jurisdiction, "comparative": comparative,
        "unanswerable": lambda c, n, s: hinted(c, "unanswerable", n, angles, s), "out_of_scope": lambda c, n, s: hinted(c, "out_of_scope", n, themes, s),
    }
    wanted = [(k, counts[k]) for k in TYPES if counts.get(k, 0) > 0]
    rows = functools.reduce(DataFrame.unionByName, [make[k](pool, n, seed) for k, n in wanted])
    place = F.coalesce(*[F.when(F.col("type") == k, F.lit(i)) for i, (k, _) in enumerate(wanted)])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("n")))
    seeds = rows.withColumn("pos", F.row_number().over(Window.orderBy("n", place)))  # as many rows as were asked for
    asked = chunks.sparkSession.createDataFrame(wanted, "type string, asked long")
    lack = asked.join(rows.groupBy("type").agg(F.count(F.lit(1)).alias("_got")), "type", "left").select("type", (F.col("asked") - F.coalesce("_got", F.lit(0))).alias("shortfall"))
    return seeds, lack.filter("shortfall > 0")
