"""Queries whose whole-table forms have no SQL of their own, against plain Python or the whole tables."""

import math
import re
from collections import Counter

import duckdb
import pytest

from evalloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


def rows(sql, sf=SF):
    return duckdb.connect().execute(re.sub(r"\{(\w+)\}", rf"'{sf}/\1.parquet'", sql)).fetchall()


def words(text):
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1]


def brute_bm25(allowed=lambda source: True):
    docs = {i: (s, words(t)) for i, s, t in rows("SELECT doc_id, source, text FROM {documents}")}
    n, average = len(docs), sum(len(w) for _, w in docs.values()) / len(docs)
    tf = {i: Counter(w) for i, (_, w) in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for item, text in rows("SELECT item_id, text FROM {benchmark}"):
        score = {}
        for i, c in tf.items():
            hits = [t for t in set(words(text)) if c[t]]
            if hits and allowed(docs[i][0]):
                score[i] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[i][1]) / average)) for t in hits)
        out[item] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:30]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("name, allowed", [("ret01_bm25_top_k_all", lambda s: True), ("ret01_bm25_filtered_all", lambda s: s == "src3")])
def test_every_question_is_ranked(spark, name, allowed):
    want = brute_bm25(allowed)
    got = {}
    for r in QUERIES[name](spark, SF).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["score"])
    assert set(got) == set(want) and max(got) >= 20
    assert all(got[k] == pytest.approx([s for _, s in want[k]], abs=2e-6) for k in want)


@pytest.mark.parametrize("name", ["ret08_select_sources", "ret12_hybrid_retrieval"])
def test_every_question_has_sources(spark, name):
    got = {r["item_id"] for r in QUERIES[name](spark, SF).select("item_id").distinct().collect()}
    assert got == set(brute_bm25())


def brute_lists():
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows("SELECT vec_id, embedding FROM {embeddings}")}
    out = {}
    for q, found in brute_bm25().items():
        out["bm25", q] = [i for i, _ in found]
    for (q,) in rows("SELECT item_id FROM {benchmark}"):
        if q in unit:
            out["vector", q] = sorted(unit, key=lambda i: (-round(sum(a * b for a, b in zip(unit[q], unit[i], strict=True)), 12), i))[:30]
    return out


def fused_of(lists, methods):
    fused = {}
    for (method, q), ids in lists.items():
        for n, i in enumerate(ids, 1):
            if method in methods:
                fused[q, i] = fused.get((q, i), 0) + {"bm25": 0.6, "vector": 1.0}[method] / (60 + n)
    return fused


def test_every_question_has_its_lists(spark):
    lists = brute_lists()
    fused = fused_of(lists, ("bm25", "vector"))
    got = {(r["q"], r["vec_id"]): r["score"] for r in QUERIES["ret05_rrf_fusion_all"](spark, SF).collect()}
    assert set(got) == set(fused) and all(got[k] == pytest.approx(fused[k], abs=2e-9) for k in got)
    docs = {i for (i,) in rows("SELECT doc_id FROM {documents}")}
    boosted = {(r["q"], r["vec_id"]) for r in QUERIES["ret06_jurisdiction_boost_all"](spark, SF).collect()}
    assert boosted == {(q, i) for q, i in fused if i in docs}
    modes = {(r["mode"], r["q"], r["rank"]): r["vec_id"] for r in QUERIES["ret16_mode_switch_all"](spark, SF).collect()}
    want = {}
    for mode, methods in (("hybrid", ("bm25", "vector")), ("bm25", ("bm25",)), ("vector", ("vector",))):
        each = {}
        for (q, i), x in fused_of(lists, methods).items():
            each.setdefault(q, []).append((-round(x, 12), i))
        want |= {(mode, q, n): i for q, found in each.items() for n, (_, i) in enumerate(sorted(found)[:8], 1)}
    assert modes == want


def test_sparse_lists_fall_back(spark):
    whole = {q: [i for i, _ in found] for q, found in brute_bm25().items()}
    of = {i for (i,) in rows("SELECT doc_id FROM {documents} WHERE source = 'src3' AND lang = 'fr'")}
    scores = {q: [i for i, _ in found] for q, found in brute_bm25(lambda s: s == "src3").items()}
    got = {tuple(r) for r in QUERIES["ret04_sparse_fallback_all"](spark, SF).select("q", "vec_id", "fallback").collect()}
    hits = {q: [i for i in found if i in of] for q, found in scores.items()}
    assert {x for x in got if x[2]} == {(q, i, True) for q, found in whole.items() if len(hits.get(q, [])) < 3 for i in found}
    assert {x for x in got if not x[2]} == {(q, i, False) for q, found in hits.items() for i in found}


def test_copy_overlap_reads_long_documents(spark):
    tri = lambda t: (lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)})([x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x])
    docs = [tri(t) for (t,) in rows("SELECT text FROM {documents}")]
    want = {i: max(len(q & c) for c in docs) / len(q) for i, t in rows("SELECT item_id, text FROM {benchmark}") if (q := tri(t))}
    got = {r["item_id"]: r["overlap"] for r in QUERIES["sta29_copy_overlap_all"](spark, SF).collect()}
    assert got == pytest.approx({i: x for i, x in want.items() if x}, abs=6e-5)


def exact(a, b):
    from fractions import Fraction

    m = a + b
    return min(1.0, float(Fraction(2 * sum(math.comb(m, i) for i in range(min(a, b) + 1)), 2**m)))


@pytest.mark.parametrize("a, b", [(0, 0), (1, 0), (540, 540), (600, 540), (1010, 968), (3103, 3103), (3000, 3206), (3206, 3000), (2900, 3306)])
def test_mcnemar_over_many_pairs(spark, a, b):
    from pyspark.sql import functions as F

    from evalloom.operators import statistics as S

    got = spark.createDataFrame([(a, b)], "a long, b long").select(S.mcnemar(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(exact(a, b), rel=1e-8)


def test_mcnemar_of_the_real_pairs(spark):
    got = QUERIES["sta07_mcnemar_p"](spark, SF).collect()
    assert got and all(r["p"] == pytest.approx(exact(r["a_only"], r["b_only"]), rel=1e-8) for r in got)


def test_every_part_is_matched(spark):
    parts = [(k, b, frozenset(x for x in re.split("[^a-z0-9]+", n.lower()) if x)) for k, b, n in rows("SELECT p_partkey, p_brand, p_name FROM {part}")]
    parts += [(900, "alone", frozenset(["odd", "ring"])), (901, "alone", frozenset(["odd", "bolt"])), (902, "alone", frozenset(["odd", "old", "bolt"]))]
    table = spark.createDataFrame([(k, b, " ".join(sorted(t))) for k, b, t in parts], "p_partkey long, p_brand string, p_name string")
    want = set()
    for k, b, x in parts:
        near = [(len(x & y) / min(len(x), len(y)), len(x & y) / len(x | y), o) for o, c, y in parts if c == b and o != k]
        near = [n for n in near if n[0] >= 0.5]
        want |= {(k, n[2], round(n[1], 9)) for n in near if n[:2] == max(near)[:2]}
    from unittest.mock import patch

    with patch("evalloom.plans.feeds.table", lambda *_: table):
        assert {(r["k"], r["other"], round(r["jaccard"], 9)) for r in QUERIES["join22_title_match_all"](spark, SF).collect()} == want


def test_every_vector_is_dealt(spark):
    vectors = sorted(i for (i,) in rows("SELECT vec_id FROM {embeddings}"))
    nth, seen, want = Counter(), set(), {}
    for rank, part, chunk in sorted((nth.update([i % 4]) or nth[i % 4], i % 4, i % 60) for i in vectors):
        if chunk not in seen:
            seen.add(chunk)
            want[chunk] = (part, len(want) + 1)
    got = QUERIES["win11_interleave_all"](spark, SF).collect()
    assert {r["vec_id"]: (r["part"], r["pos"]) for r in got} == want and len(got) == len(want)


def test_every_event_has_its_flag_and_changes(spark):
    import json

    value = {i: json.loads(p)["k"] for i, p in rows("SELECT event_id, props FROM {events}")}
    assert {r["event_id"]: r["k"] for r in QUERIES["flt08_json_flag_all"](spark, SF).collect()} == {i: str(k) for i, k in value.items()}
    want = {i: ",".join([*(["a.k"] if k != value[i + 1] else []), "a.m"]) for i, k in value.items() if i + 1 in value}
    assert {r["event_id"]: r["changed"] for r in QUERIES["map02_config_diff"](spark, SF).collect()} == want


def test_tokens_of_every_document(spark):
    from pyspark.sql import functions as F

    from evalloom.operators.documents import count_tokens, token_count

    want = {i: count_tokens(t or "") for i, t in rows("SELECT doc_id, text FROM {documents}")}
    assert {r["doc_id"]: r["n"] for r in QUERIES["doc12_token_counts_all"](spark, SF).collect()} == want
    odd = "Größe élan naïve_x 東京 ½ ٣٤ a b\x1cc – “q”"
    assert spark.createDataFrame([(odd,)], "t string").select(token_count(F.col("t"))).first()[0] == count_tokens(odd)
