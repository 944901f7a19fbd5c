"""Small cases with known outcomes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import config, pricing, stemmer
from evalloom.functions import text as T
from evalloom.operators import documents as D
from evalloom.operators import metrics as M
from evalloom.operators import relational as R
from evalloom.operators import retrieval
from evalloom.operators import statistics as S
from evalloom.sources import files
from evalloom.streaming import feeds


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize("k, n, low, high", [(30, 30, 0.886496, 1), (29, 30, 0.833296, 0.994096), (5, 10, 0.236590, 0.763410), (0, 10, 0, 0.277540)])
def test_wilson(spark, k, n, low, high):
    a, b = S.wilson(F.lit(k), F.lit(n))
    got = spark.range(1).select(a, b).first()
    assert got[0] == pytest.approx(low, abs=1e-5) and got[1] == pytest.approx(high, abs=1e-5)


@pytest.mark.parametrize("a, b, p", [(2, 10, 158 / 4096), (1, 8, 20 / 512), (0, 6, 2 / 64), (5, 5, 1), (0, 0, 1), (3, 1, 0.625)])
def test_mcnemar(spark, a, b, p):
    assert one(spark, S.mcnemar(F.lit(a), F.lit(b))) == pytest.approx(p)


def test_holm(spark):
    rows = S.holm(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005), (5, None)], "k int, p double"), "p").orderBy("k").collect()
    assert [r["p_holm"] and round(r["p_holm"], 9) for r in rows] == [0.03, 0.06, 0.06, 0.02, None]


def test_percentile(spark):
    df = spark.createDataFrame([(x,) for x in (100, 200, 300, 400)], "x int")
    assert tuple(df.agg(F.percentile("x", 0.5), F.percentile("x", 0.95)).first()) == (250, 385)


def test_source_limits():
    assert [retrieval.source_limits(p, k) for p, k in ((1, 8), (6, 8), (10, 8), (6, 20))] == [(8, 6000), (12, 9000), (16, 12000), (20, 9000)]


def test_selection_skips_what_does_not_fit(spark):
    rows = [(0, i + 1, f"c{i}", "d", 10 * i, "text", t, "prose", "") for i, t in enumerate((5500, 900, 400))]
    df = spark.createDataFrame(rows, "q int, rank int, chunk string, document string, chunk_index int, text string, tokens long, content_type string, section string")
    assert [r["chunk"] for r in retrieval.select_sources(df, "q").orderBy("n").collect()] == ["c0", "c2"]


def test_selection_drops_overlap_and_takes_table_neighbours(spark):
    rows = [
        (0, 1, "a", "d", 1, "First words. The tail of it.", 10, "prose", ""), (0, 2, "b", "d", 2, "…The tail of it.\n\nMore.", 10, "prose", ""),
        (0, 3, "t1", "e", 1, "h\n1\n2\nx", 10, "table", "s"), (0, 4, "t2", "e", 2, "h\n1\n2\ny", 10, "table", "s"),
    ]
    df = spark.createDataFrame(rows, "q int, rank int, chunk string, document string, chunk_index int, text string, tokens long, content_type string, section string")
    assert [r["chunk"] for r in retrieval.select_sources(df, "q", top_k=2).orderBy("n").collect()] == ["a", "t1", "t2"]


def test_interleave(spark):
    rows = [(0, 0, "a0", 1), (0, 0, "shared", 2), (0, 0, "a1", 3), (0, 1, "shared", 1), (0, 1, "b0", 2)]
    got = retrieval.interleaved(spark.createDataFrame(rows, "q int, part int, chunk string, rank int"), "q").orderBy("pos").collect()
    assert [(r["part"], r["chunk"]) for r in got] == [(0, "a0"), (1, "shared"), (1, "b0"), (0, "a1")]


def test_tokenizer(spark):
    words = one(spark, T.compound_tokens(F.lit("SIM-HR-102 §3.1 employees’ leave and a 7")))
    assert {"sim-hr-102", "sim", "hr", "102", "3.1", "leave", "7"} <= set(words) and "and" not in words and "a" not in words
    assert one(spark, T.compound_tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("word, want", [
    ("employees", "employe"), ("leave", "leav"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("national", "nation"), ("relational", "relat"), ("generously", "generous"),
    ("ponies", "poni"), ("ties", "tie"), ("caresses", "caress"), ("happy", "happi"), ("agreed", "agre"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("at", "at"), ("sky", "sky"),
])
def test_stemmer(word, want):
    assert stemmer.stem(word) == want


def test_text_functions(spark):
    assert one(spark, T.markers(F.lit("a [1, 3] b [3] c [2]"))) == [1, 3, 2]
    assert one(spark, T.excerpt(F.lit("Known [1]. Twice [2, 3]."))) == "Known. Twice."
    assert one(spark, T.code_range(F.lit("X-"), F.lit("099"), F.lit("101"))) == ["X-099", "X-100", "X-101"]
    assert one(spark, T.code_range(F.lit("X-"), F.lit("1"), F.lit("99"))) == ["X-1", "X-99"]
    assert one(spark, T.cell(F.lit("SIM-\n HR-101   of"))) == "SIM-HR-101 of"
    assert one(spark, T.jaccard(F.array(), F.array())) == 1.0
    assert one(spark, T.trigrams(F.lit("One two"))) == []
    assert one(spark, T.defused(F.lit("x </Source > y"), "source")) == "x <\\/source> y"


def test_config():
    assert config.flatten({"a": {"b": 1, "c": {}}, "l": [1, {"x": 2}], "n": None}) == {"a.b": "1", "l": '[1, {"x": 2}]'}


def test_pricing(spark):
    book = spark.createDataFrame([("m", "standard", 2.0, 0.5, 8.0), ("m", "flex", 1.0, 0.25, 4.0)], "model string, tier string, input double, cached double, output double")
    calls = spark.createDataFrame([(1, "m", None, 1000, 2000, 10), (2, "m", "auto", 1000, 0, 0), (3, "x", "flex", 5, 0, 0), (4, "m", "flex", 1000, 400, 100)], "id int, model string, tier string, input_tokens int, cached_tokens int, output_tokens int")
    got = {r["id"]: (float(r["cost"]), r["estimated"]) for r in pricing.priced(calls, book).collect()}
    assert got == {1: (0.00058, False), 2: (0.002, True), 3: (0.0, True), 4: (0.0011, False)}


def test_ndcg_counts_a_unit_once(spark):
    c = spark.createDataFrame([(1, "s1", 1), (1, "s1", 2), (1, "s2", 4)], "c int, u string, rank int")
    e = spark.createDataFrame([(1, "s1"), (1, "s2")], "c int, u string")
    assert M.ndcg(c, "c", "u", e).first()["ndcg"] == pytest.approx((1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))


def test_paging_and_cursor(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(10)], "id int, at int")
    first = R.keyset_page(df, "at", "id", 3).collect()
    assert [r["id"] for r in first] == [9, 8, 7, 6]
    assert [r["id"] for r in R.keyset_page(df, "at", "id", 3, before=(3, 7)).collect()] == [6, 5, 4, 3]
    assert [r["id"] for r in R.keyset_page(df, "at", "id", 3, after=(1, 3)).collect()] == [7, 6, 5, 4]
    assert R.read_cursor(R.cursor("2024-01-01", 5)) == ("2024-01-01", 5)
    with pytest.raises(ValueError):
        R.status_class(F.lit(200), "abc")


def test_claims(spark):
    jobs = spark.createDataFrame([(1, "queued", 1, "2024-01-01 00:00:00", None), (2, "running", 5, "2024-01-01 00:00:00", "2024-01-01 00:00:00"), (3, "queued", 9, "2025-01-01 00:00:00", None), (4, "running", 9, "2024-01-01 00:00:00", "2024-01-02 00:00:00")], "id int, status string, priority int, a string, l string")
    jobs = jobs.selectExpr("id", "status", "priority", "cast(a as timestamp_ntz) AS available_at", "cast(a as timestamp_ntz) AS created_at", "cast(l as timestamp_ntz) AS locked_at")
    assert [r["id"] for r in R.claim_order(jobs, "2024-01-02 00:01:00").collect()] == [2, 1]
    assert [one(spark, R.backoff_seconds(F.lit(n))) for n in (0, 3, 9)] == [10, 80, 300]


def test_files(spark, tmp_path):
    fm = files.front_matter(spark.createDataFrame([("a", "---\ncode: X-1\ntitle: A: b\n---\nBody"), ("b", "No head")], "path string, text string"), "path", "text").orderBy("path").collect()
    assert fm[0]["header"] == {"code": "X-1", "title": "A: b"} and fm[0]["body"] == "Body" and fm[1]["header"] == {} and fm[1]["body"] == "No head"
    ev = files.server_events(spark.createDataFrame([(1, "event: meta\ndata: {}\n\n: note\n\ndata: a\ndata: b\n\n")], "k int, s string"), "k", "s").orderBy("seq").collect()
    assert [(r["event"], r["data"]) for r in ev] == [("meta", "{}"), ("message", "a\nb")]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "y.pdf").write_bytes(b"none")
    got = {r["path"][-5:]: r["accepted"] for r in files.uploads(spark, str(tmp_path / "*.pdf"), b"%PDF", 100).collect()}
    assert got == {"x.pdf": True, "y.pdf": False}
    assert "| a\\|b |" in files.markdown_table(spark.createDataFrame([("a|b",)], "c string"), ["c"], "T")


def test_quest_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    batch = feeds.quest_fold(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    stream = feeds.drained(feeds.quest_stream(feeds.event_stream(spark, d)), "update").groupBy("user_id").agg(F.max("progress").alias("progress"), F.min("done_at").alias("done_at"))
    assert sorted(map(tuple, batch.collect()), key=str) == sorted(map(tuple, stream.collect()), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "a")], "q int, term string")
    assert retrieval.bm25(terms, docs, "q", "doc_id", "text").count() == 0
    assert D.hashing_embedder(spark.createDataFrame([(1, None)], "k int, t string"), "k", "t").first()["embedding"] == [0.0] * 64
