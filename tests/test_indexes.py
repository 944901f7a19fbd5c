"""Lists by the two indexes against scoring everything: blocks of postings, and cells of vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import block_index as BI
from evalloom.operators import retrieval as R
from evalloom.operators import vector_cells as V
from evalloom.sources import snapshots


def test_packing_gives_back_what_went_in():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n_docs, most = int(rng.integers(1, 3000)), int(rng.integers(1, 4000))
        pairs = np.unique(rng.integers(0, 30, most) ** 2 // 30 * n_docs + rng.integers(0, n_docs, most))
        code, doc = pairs // n_docs, pairs % n_docs
        tf, lengths = rng.geometric(0.2, len(code)) ** 2, rng.integers(0, 500, n_docs)
        terms, first, last, n, d_bits, t_bits, max_tf, min_length, sizes, data = BI._segment(lengths, doc, code, tf)
        at = np.cumsum(sizes) - sizes
        x, y = BI.unpack(data, at, first, n, d_bits, t_bits)
        assert (x == doc).all() and (y == tf).all() and n.max() <= BI.BLOCK
        ends = np.cumsum(n)
        assert (doc[ends - 1] == last).all() and (np.maximum.reduceat(tf, ends - n) == max_tf).all() and (np.minimum.reduceat(lengths[doc], ends - n) == min_length).all()
        some = rng.permutation(len(n))[: len(n) // 2 + 1]
        x, _ = BI.unpack(data, at[some], first[some], n[some], d_bits[some], t_bits[some])
        assert x.tolist() == [d for k in some for d in doc[ends[k] - n[k] : ends[k]]]


def zipf(n, seed):
    rnd = random.Random(seed)
    return " ".join(f"w{int(rnd.paretovariate(0.7)) % 500}" for _ in range(n))


def test_lists_equal_scores_of_all_documents_and_blocks_are_skipped(spark, tmp_path):
    """Skewed terms, many ties by copies, a filter, repeated keys, empty texts, terms that nothing has."""
    docs = [(i, zipf(5 + i * 7 % 200, i % 900), f"s{i % 5}") for i in range(3000)] + [(4000, None, "s1"), (4001, "", "s1"), (7, "w3 w3 w9", "s2")]
    df = spark.createDataFrame(docs, "key long, text string, side string")
    path = str(tmp_path / "i")
    BI.write(df, path, "key", "key", "text", T.simple_tokens, ("side",), buckets=2)
    index = snapshots.read(spark, path)
    terms = spark.createDataFrame([(q, t) for q in range(60) for t in {f"w{q}", f"w{q * 7 % 40}", "w2", "none"}], "q int, term string")
    rows = df.withColumn("id", F.when((F.col("key") == 7) & (F.col("side") == "s2") & (F.length("text") < 9), 9007).otherwise(F.col("key")))  # the scan needs keys of its own
    for allowed in (None, F.col("side") == "s3"):
        scores = R.bm25_scores(terms, rows, "q", "id", "text", rows.filter(allowed) if allowed is not None else None, T.simple_tokens) if allowed is None else R.bm25_scores(terms, rows, "q", "id", "text", rows.filter(allowed).select("id"), T.simple_tokens)
        want = {}
        for r in scores.collect():
            want.setdefault(r["q"], []).append((-round(r["score"], 9), 7 if r["id"] == 9007 else r["id"]))
        got = {}
        for r in BI.search(index, terms, "q", "key", 10, allowed).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append((-round(r["score"], 9), r["key"]))
        assert {q: sorted(x)[:10] for q, x in want.items()} == got
    met, read = (sum(x) for x in zip(*BI.search(index, terms, "q", "key", 10, counts=True).collect(), strict=True))
    assert read < 0.8 * met
    assert BI.search(index, terms.limit(0), "q", "key").count() == 0
    BI.write(df.limit(0), str(tmp_path / "e"), "key", "key", "text", T.simple_tokens)
    assert BI.search(snapshots.read(spark, str(tmp_path / "e")), terms, "q", "key").count() == 0


def cosine(rows, q, k, allowed=lambda s: True):
    unit = lambda v: np.array(v) / np.sqrt((np.array(v) ** 2).sum())
    found = sorted((-round(float(unit(q) @ unit(v)), 12), i) for i, v, s in rows if v and all(x is not None for x in v) and any(v) and len(v) == len(q) and i is not None and allowed(s))
    return [(i, pytest.approx(-s, abs=1e-9)) for s, i in found[:k]]


def test_cells_give_the_lists_of_a_scan(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12)) * 4
    rows = [(i, (centres[i % 30] + rng.normal(size=12) * 0.3).tolist(), f"s{i % 4}") for i in range(2500)]
    rows += [(3000 + i, rows[5][1], "s1") for i in range(700)] + [(9000, None, "s1"), (9001, [0.0] * 12, "s1"), (9002, [1.0, 2.0], "s1"), (9003, [None] * 12, "s1"), (None, [1.0] * 12, "s1"), (8, rows[8][1], "s0"), (8, rows[8][1], None)]
    df = spark.createDataFrame(rows, "id long, v array<float>, s string")
    rows = [(r["id"], r["v"], r["s"]) for r in df.collect()]
    path = str(tmp_path / "v")
    fitted = V.write(df, path, "id", "v", ("s",))
    asked = [(i, v) for i, v, _ in rows[:200:9]] + [(700, [0.0] * 12), (701, None), (702, [1.0])]
    queries = spark.createDataFrame(asked, "q long, qv array<float>")
    for size in (5000, 7):
        monkeypatch.setattr(V, "BLOCK_QUERIES", size)
        for allowed, of in ((None, lambda s: True), (lambda m: m["s"] == "s1", lambda s: s == "s1")):
            got = {}
            for r in V.search(spark, path, fitted, queries, "q", "qv", "id", 8, allowed).orderBy("q", "rank").collect():
                got.setdefault(r["q"], []).append((r["id"], r["score"]))
            assert got == {q: cosine(rows, v, 8, of) for q, v in asked[:-3]}
    pairs, scored = V.search(spark, path, fitted, queries, "q", "qv", "id", 8, counts=True).first()
    assert scored < 0.4 * pairs
    empty = V.write(df.limit(0), str(tmp_path / "e"), "id", "v")
    assert V.search(spark, str(tmp_path / "e"), empty, queries, "q", "qv", "id").count() == 0
