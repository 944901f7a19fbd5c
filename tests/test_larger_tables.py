"""Queries on rows that only larger tables have."""

import hashlib
import random

from compare import compare
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import block_index as BI
from evalloom.operators import layout as L
from evalloom.operators import retrieval as R
from evalloom.plans import ORACLES, QUERIES
from evalloom.plans import ingestion as I
from evalloom.sources import corpus as S
from evalloom.sources import snapshots

SF = "/root/testdata/sf0.001"


def test_outline_of_large_keys(spark, tmp_path):
    """Section numbers over 999, as suppliers' keys are on tables larger than sf0.1."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey < 200").select("*", F.explode(F.array(*map(F.lit, (0, 998, 12_345_678_901)))).alias("_c"))
    moved = rows.withColumns({c: F.col(c) + F.col("_c") for c in ("l_orderkey", "l_partkey", "l_suppkey")}).drop("_c")
    moved.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    name = "doc05_contents_and_outline"
    assert compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path)) == ""


def test_objects_over_the_limit_of_a_value(spark, tmp_path, monkeypatch):
    """Files longer than what one value may hold, with and without a last line feed and a byte order mark."""
    noise = random.Random(1)
    files = {"a b%20c+d.bin": noise.randbytes(30_000), "é.txt": b"\xef\xbb\xbfone\r\n\n" * 900, "feeds": b"\n" * 5000, "mark": b"\xef\xbb\xbf" + b"x" * 4000, "long": b"y" * 20_000, "few.gz": b"\nno archive\n"}
    (tmp_path / "org").mkdir()
    for name, data in files.items():
        (tmp_path / "org" / name).write_bytes(data)
    monkeypatch.setattr(S, "WHOLE", 1000, raising=False)
    monkeypatch.setattr(S, "PIECE", 700, raising=False)
    settings = {"spark.sql.sources.binaryFile.maxLength": "2000", "spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "100"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {(r["org_id"], r["document_id"]): (r["digest"], r["size"]) for r in S.stored_objects(spark, str(tmp_path)).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == {("org", n.rsplit(".", 1)[0]): (hashlib.sha256(x).hexdigest(), len(x)) for n, x in files.items()}


def test_lines_are_made_once(spark):
    """Texts laid out inside a batch give the lines of the words as rows, and levels read finished lines however often they need them."""
    odd = [(1, None), (2, ""), (3, " \t\n  "), (4, "one\r\ntwo three .\n\n" * 50 + "x" * 40), (None, "no id here"), (6, "long " * 30_000)]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(extra.withColumn("doc_id", F.col("doc_id") + 10_000_000))

    def shown(df):
        return sorted(map(repr, df.collect()))

    own, table = L.lines_of(docs, "doc_id", "text", I._laid_out), I.table
    I.table = lambda spark, d, name: docs
    try:
        words = I._words(spark, SF)
    finally:
        I.table = table
    want = shown(L.lines(words, "doc_id", in_order=True))
    assert shown(own) == want == shown(L.lines(words.repartition(7), "doc_id")) and len(want) > 1000
    assert "MapInArrow" not in L.levels(own, "doc_id")._jdf.queryExecution().executedPlan().toString()


def test_cosine_without_scores_and_ties(spark, tmp_path):
    """The lists of SQL where vectors repeat, over several blocks of pairs, and rows without a score behind the others."""
    same = [float(x) for x in range(1, 9)]
    rows = [(i, same if i % 3 else [float((i * 7 + j * j) % 11 - 5) for j in range(8)], 0) for i in range(3000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    e.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    name = "ret02_cosine_unindexed"
    assert compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path)) == ""
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, None]), (6, [1.0, 1.0])], "k long, v array<double>")
    got = R.cosine_top_k(few.withColumnRenamed("k", "q"), few, "q", "v", "k", "v", 3)
    lists = {q: [(r["k"], r["score"] and round(r["score"], 3)) for r in sorted(got.filter(F.col("q") == q).collect(), key=lambda r: r["rank"])] for q in (1, 2, 4)}
    assert lists == {1: [(1, 1.0), (6, 0.707), (2, None)], 2: [(1, None), (2, None), (3, None)], 4: [(4, 1.0), (1, None), (2, None)]}


def test_run_lists_in_blocks(spark, monkeypatch):
    """Lists do not depend on blocks, and a vector without a length stands last instead of being divided by."""
    words = ["leave", "travel", "pay", "safety", "notice"]
    chunks = [(i, i // 2, f"d{i % 3}" if i % 7 else None, " ".join(words[: i % 6]) if i % 5 else None, None if i % 11 == 1 else [0.0, 0.0] if i == 4 else [float(i % 9), 1.0]) for i in range(60)]
    parts = [(q, p, f"{words[q % 5]} {words[p]}", [1.0, float(q)] if q % 3 else None, [(["d1"], None), (["d9"], [1, 2, 3])] if q % 2 else None) for q in range(7) for p in range(2)]
    c = spark.createDataFrame(chunks, "key long, document long, department string, text string, vector array<double>")
    q = spark.createDataFrame(parts, "query long, part int, text string, vector array<double>, filters array<struct<departments: array<string>, documents: array<long>>>")
    find = lambda **given: sorted(map(str, R.run_lists(q, c, k=8, **given).collect()))
    whole, simple = find(), find(tokens=T.simple_tokens)
    monkeypatch.setattr(R, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(R, "PAIRS", 16, raising=False)
    assert find() == whole and find(tokens=T.simple_tokens) == simple and any("fallback=True" in r for r in whole)
    rows = R.run_lists(q.filter("query = 2 and part = 0"), c, mode="vector", k=100).orderBy("rank").collect()
    assert len(rows) == sum(v is not None for *_, v in chunks) and rows[-1]["key"] == 4


def test_totals_of_segments(spark, tmp_path, monkeypatch):
    """Terms are counted segment by segment, also after documents were replaced and emptied, without exchanging postings."""
    monkeypatch.setattr(BI, "SEGMENT_DOCS", 7)
    rows = [(i, i, "alpha " * (i % 4) + ("beta gamma" if i % 3 else "")) for i in range(60)]
    docs, path = spark.createDataFrame(rows, "doc long, key long, text string"), f"{tmp_path}/index"
    BI.write(docs, path, "doc", "key", "text", T.simple_tokens, buckets=2)
    BI.write(docs.filter("doc % 10 = 0").withColumn("text", F.lit("delta delta")), path, "doc", "key", "text", T.simple_tokens, asked=docs.filter("doc % 5 = 0"))
    texts = {i: "delta delta" if i % 10 == 0 else t for i, _, t in rows if i % 10 != 5}
    want = {w: (sum(w in t for t in texts.values()), sum(t.split().count(w) for t in texts.values()), max(len(t.split()) for t in texts.values() if w in t)) for w in ("alpha", "beta", "gamma", "delta")}
    found = BI.term_totals(snapshots.read(spark, path))
    assert {r["term"]: (r["df"], r["tf"], r["longest"]) for r in found.collect()} == want
    assert BI.documents_of(snapshots.read(spark, path)).count() == len(texts)
