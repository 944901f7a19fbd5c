"""Alignment against whole texts encoded by the libraries and aligned token by token."""

import hashlib
import random
from collections import Counter

import pytest

from evalloom.llm import alignment as A
from evalloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = ["a", "the ", "  ", "\n", "\n\n ", "\t", "é", "日本語", " x", "▁", "'s", "don't", " 's", "123", " 4567", "!!", "<|endoftext|>", "<s>", " ", " ", "\x1c", "\x85", "\x00", "🙂", "hello world", "   y", " ", "ß", "\r\n", "​", "é"]


@pytest.fixture(scope="module")
def tool():
    return A.Aligner(*A.tokenizer_paths())


def whole(tool, text):
    """(A's ids, B's ids, groups, links) of a text as the contract says, or nothing."""
    if not text:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(k): k for k in printable} | {chr(256 + k): x for k, x in enumerate(k for k in range(256) if k not in printable)}
    spelled = {i: w for w, i in tool.a.get_vocab().items()}
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    x = [bytes(byte[c] for c in spelled[i]) for i in a]
    y = [bytes([int(p[3:5], 16)]) if tool.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tool.b.id_to_piece(i)]]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return None
    spans = []
    for tokens in (x, y):
        at, own = 0, []
        for t in tokens:
            own.append((at, at + len(t)))
            at += len(t)
        spans.append(own)
    links = [(i, j) for k, i in enumerate(a) for m, j in enumerate(b) if spans[0][k][0] < spans[1][m][1] and spans[1][m][0] < spans[0][k][1]] if len(a) < 400 else near(a, b, *spans)
    groups, last = [], 0
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        sides = [",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if last <= s and e <= end) for ids, own in zip((a, b), spans, strict=True)] if len(a) < 400 else None
        groups.append("|".join(sides) if sides else None)
        last = end
    return len(a), len(b), groups, Counter(links)


def near(a, b, x, y):
    out, m = [], 0
    for k, (s, e) in enumerate(x):
        while y[m][1] <= s:
            m += 1
        n = m
        while n < len(y) and y[n][0] < e:
            out.append((a[k], b[n]))
            n += 1
    return out


def test_words_in_turn_are_the_text(tool):
    rnd = random.Random(3)
    texts = [None, "", " ", "  ", "x" * 300, " ".join("ab" for _ in range(300))] + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(700)]
    got = tool.align(texts)
    some = 0
    for k, text in enumerate(texts):
        want = whole(tool, text)
        some += want is not None
        a, b, groups, links = want or (0, 0, [], Counter())
        assert tuple(got[c][k].as_py() for c in ("n_a", "n_b", "n_groups", "n_links", "groups")) == (a, b, len(groups), sum(links.values()), ";".join(groups)), text
        assert {x["pair"]: x["n"] for x in got["links"][k].as_py()} == {i << A.SHIFT | j: n for (i, j), n in links.items()}, text
    assert some > 200
    tool.forget()


def expected(tool, rows):
    found = [(i, whole(tool, t)) for i, t in rows]
    counts = Counter(p for _, w in found if w for p in w[3])
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for i, w in found:
        a, b, groups, links = w or (0, 0, [], {})
        out.append((i, a, b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), groups))
    return out


@pytest.mark.parametrize("bound", [500_000, 0])
def test_counts_over_all_rows(spark, tool, monkeypatch, bound):
    """Nulls, repeated rows and ids, ties of counts, other columns of the same names; both ways of joining."""
    monkeypatch.setattr(A, "BROADCAST_PAIRS", bound)
    rows = [(1, "tokenization of unbelievable words"), (1, "tokenization of unbelievable words"), (2, None), (3, ""), (None, "words of"), (4, "a ▁ sign"), (5, "Überschwänglich 日本語"), (6, "of\nof  of")]
    df = spark.createDataFrame([(i, t, 1, 2, "g") for i, t in rows], "doc_id long, text string, n_a int, pair int, groups string")
    got = A.scored(A.groups(df, *A.tokenizer_paths())).collect()
    want = expected(tool, rows)
    assert sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in got), key=str) == sorted(((*w[:7], ";".join(w[7])) for w in want), key=str)
    assert A.scored(A.groups(df.limit(0), *A.tokenizer_paths())).count() == 0


def test_query(spark, tool):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {w[0]: w for w in expected(tool, rows)}
    got = QUERIES["op12_token_alignment"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == w[1:7]
        if None not in w[7]:
            assert r["groups_sha256"] == (hashlib.sha256(";".join(w[7]).encode()).hexdigest() if w[1] else "")
