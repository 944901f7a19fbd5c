"""Versioned tables: what is replaced, what stays, what a reader sees meanwhile, and what a failed or a second writer leaves."""

import pytest

from evalloom.functions import text as T
from evalloom.operators import block_index as BI
from evalloom.sources import snapshots as S

SCHEMA = "k string, v int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, path, version=None):
    return sorted(map(tuple, S.read(spark, path, version).select("k", "v").collect()), key=str)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


def test_replacement_and_versions(spark, path):
    assert S.versions(spark, path) == [] and S.counted(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        S.read(spark, path)
    assert S.replace(table(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)]), path, ["k"], buckets=4) == 1
    assert S.replace(table(spark, [("b", 5), ("c", 6)]), path, ["k"]) == 2
    assert state(spark, path) == [("a", 1), ("a", 2), ("b", 5), ("c", 6), (None, 4)] and S.counted(spark, path) == 5
    assert state(spark, path, 1) == [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    assert S.remove(spark.createDataFrame([("a",), (None,)], "k string"), path, ["k"]) == 3
    assert state(spark, path) == [("b", 5), ("c", 6)] and S.counted(spark, path, 1) == 4
    with pytest.raises(ValueError):
        S.replace(table(spark, [("a", 1)]).withColumnRenamed("v", "w"), path, ["k"])
    with pytest.raises(ValueError):
        S.replace(table(spark, [("a", 1)]), path, ["v"])


@pytest.mark.parametrize("buckets", [1, 64])
def test_a_key_without_new_rows_goes(spark, path, buckets):
    """Alone in its bucket, beside others, and as the last of the table."""
    S.replace(table(spark, [("a", 1), ("b", 2)]), path, ["k"], buckets=buckets)
    asked = lambda k: spark.createDataFrame([(k,)], "k string")
    S.replace(table(spark, []), path, ["k"], asked=asked("a"))
    assert state(spark, path) == [("b", 2)]
    S.replace(table(spark, []), path, ["k"], asked=asked("b"))
    assert state(spark, path) == [] and S.counted(spark, path) == 0
    S.replace(table(spark, [("c", 3)]), path, ["k"])
    assert state(spark, path) == [("c", 3)] and state(spark, path, 1) == [("a", 1), ("b", 2)]


def test_upsert_and_insert_missing(spark, path):
    S.upsert(table(spark, [("a", 1), ("b", 2)]), path, ["k"])
    S.upsert(table(spark, [("b", 3), (None, 4)]), path, ["k"])
    assert state(spark, path) == [("a", 1), ("b", 3), (None, 4)]
    with pytest.raises(ValueError):
        S.upsert(table(spark, [("x", 1), ("x", 2)]), path, ["k"])
    S.insert_missing(table(spark, [("a", 9), ("c", 5), ("c", 5), (None, 7)]), path, ["k"])
    assert state(spark, path) == [("a", 1), ("b", 3), ("c", 5), (None, 4)]


def test_a_failed_write_leaves_the_old_version(spark, path, monkeypatch):
    S.replace(table(spark, [("a", 1)]), path, ["k"])
    publish = S._commit
    monkeypatch.setattr(S, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        S.replace(table(spark, [("a", 2)]), path, ["k"])
    monkeypatch.setattr(S, "_commit", publish)
    assert state(spark, path) == [("a", 1)] and S.versions(spark, path) == [1]
    S.replace(table(spark, [("a", 3)]), path, ["k"])
    assert state(spark, path) == [("a", 3)]
    assert len(S.expire(spark, path, keep=1, older_than_s=0)) == 2 and S.versions(spark, path) == [2]  # the lost write's files, and version 1
    assert state(spark, path) == [("a", 3)] and S.expire(spark, path, keep=1, older_than_s=0) == []


def test_of_two_writers_one_has_to_begin_anew(spark, path, monkeypatch):
    S.replace(table(spark, [("a", 1)]), path, ["k"])
    old = S.manifest(spark, path)
    S.replace(table(spark, [("b", 2)]), path, ["k"])
    monkeypatch.setattr(S, "manifest", lambda *a: old)
    with pytest.raises(S.Conflict):
        S.replace(table(spark, [("c", 3)]), path, ["k"])
    monkeypatch.undo()
    assert state(spark, path) == [("a", 1), ("b", 2)] and [n for n, _ in S._listed(spark, f"{path}/_versions") if not n.endswith((".json", ".crc"))] == []


def index_state(spark, path, version=None):
    index = S.read(spark, path, version)
    docs = BI.documents_of(index)
    rows = BI.postings_of(index).join(docs.select("segment", "number", "key", "length"), ["segment", "number"])
    return sorted((r["key"], r["term"], r["tf"], r["length"]) for r in rows.collect()), sorted(r["key"] for r in docs.collect())


def test_index_of_a_document_that_is_emptied(spark, path):
    """A document that is the only one of its bucket, written again with an empty text, and with no chunk at all."""
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three")], "id long, text string")
    BI.write(docs, path, "id", "id", "text", T.simple_tokens)
    assert index_state(spark, path) == ([(1, "one", 1, 3), (1, "two", 2, 3), (2, "three", 1, 2), (2, "two", 1, 2)], [1, 2])
    BI.write(docs.filter("id = 1").selectExpr("id", "'' AS text"), path, "id", "id", "text", T.simple_tokens)
    assert index_state(spark, path) == ([(2, "three", 1, 2), (2, "two", 1, 2)], [1, 2])
    assert tuple(BI.stats(S.read(spark, path)).first()) == (2, 1.0)
    BI.write(docs.filter("false"), path, "id", "id", "text", T.simple_tokens, asked=docs.filter("id = 1"))
    BI.write(docs.filter("false"), path, "id", "id", "text", T.simple_tokens, asked=docs.filter("id = 2"))
    assert index_state(spark, path) == ([], []) and tuple(BI.stats(S.read(spark, path)).first()) == (0, 0.0)
    assert index_state(spark, path, 1)[1] == [1, 2]


def test_index_equals_one_that_is_written_anew(spark, path, tmp_path, monkeypatch):
    """After replacements in small segments: same postings, same lists."""
    monkeypatch.setattr(BI, "SEGMENT_POSTINGS", 50)
    monkeypatch.setattr(BI, "SEGMENT_DOCS", 7)
    words = lambda i, n: " ".join(f"w{(i * j * j + j) % 23}" for j in range(n))
    first = [(i, i // 3, words(i, i % 40), "x") for i in range(200)] + [(500, None, "no document", "x"), (501, 5, None, "y")]
    again = [(i, i // 3, words(i + 7, 11), "y") for i in range(60, 90)]
    schema = "key long, doc long, text string, side string"
    BI.write(spark.createDataFrame(first, schema), path, "doc", "key", "text", T.simple_tokens, ("side",), buckets=4)
    BI.write(spark.createDataFrame(again, schema), path, "doc", "key", "text", T.simple_tokens, ("side",))
    left = [r for r in first if r[1] is None or not 20 <= r[1] < 30] + again
    other = str(tmp_path / "other")
    BI.write(spark.createDataFrame(left, schema), other, "doc", "key", "text", T.simple_tokens, ("side",), buckets=3)
    assert index_state(spark, path) == index_state(spark, other)
    terms = spark.createDataFrame([(q, f"w{w}") for q in range(20) for w in {q, 2 * q % 23, 5}], "q int, term string")
    lists = lambda p, **k: sorted((r["q"], r["key"], round(r["score"], 9), r["rank"]) for r in BI.search(S.read(spark, p), terms, "q", "key", 6, **k).collect())
    assert lists(path) == lists(other) and len(lists(path)) == 20 * 6
    assert lists(path, allowed=S.F.col("side") == "y") == lists(other, allowed=S.F.col("side") == "y") != lists(path)
