"""Each corpus operator on small tables: plain cases, nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from evalloom.llm import bradley_terry, decontamination, licenses, line_dedup, near_dup, pieces, quality_rules, sharding, suffix_dedup, token_files
from evalloom.llm.components import components
from evalloom.llm.oracles import ORACLES
from evalloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, host string, key string, pos int, value long, n int, shard int, size long, a long, b long, node string, kept_text string"
rnd = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


ORIGINAL = prose(120)
LINE = "A common Line of text"
ROWS = (
    [(0, None), (1, ""), (2, " \n\t\n"), (3, "one two"), (3, "one two"), (None, prose(30)), (None, None), (4, "é" * 5000 + " " + prose(3000))]
    + [(10 + i, ORIGINAL if i % 3 == 0 else ORIGINAL.replace(f" w{i} ", f" x{i} ", 1)) for i in range(12)]
    + [(30 + i, f"{prose(20)}\n {LINE.upper() if i % 2 else LINE} \n{prose(15)}") for i in range(12)]
    + [(50 + i, prose(40)) for i in range(10)] + [(70, "w1 w2 w3 w4 w5 w6 w7 " * 20), (71, "### $$$ *** " * 10)]
)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 3}" if d != 2 else None, len(t or ""), 7, "h", "k", 1, 2, 3, 4, 5, 6, 7, "x", "y") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def test_decontamination(spark, docs, empty):
    item = "the quick brown fox jumps over a lazy dog near one old river bank at noon today"
    swapped = item.replace("jumps", "leaps").replace("old", "new")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too short"), (5, prose(40))], "item_id long, text string")
    rows = table(spark, ROWS + [(100, f"{prose(50)} {swapped} {prose(9)}"), (101, item.upper()), (102, " ".join(item.split()[:8]) + " " + prose(30)), (101, item.upper())])
    got = {}
    for r in decontamination.overlaps(rows, items).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    want = {}
    for d, t in [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]:
        if found := brute.leaks(t, [(r["item_id"], r["text"]) for r in items.collect()]):
            want[d] = found
    assert got == want and got[100] == {1, 2} and 102 not in got
    clean = decontamination.decontaminate(rows, items)
    assert clean.count() == rows.count() - 3 and "_row" not in clean.columns and "key" in clean.columns
    assert decontamination.overlaps(empty, items).count() == 0 and decontamination.overlaps(docs, items.limit(0)).count() == 0


def test_short_items_are_found_whole(spark, empty):
    items = spark.createDataFrame([(1, "only four words here"), (2, "one"), (3, "seven words are one short of eight"), (4, "!!")], "item_id long, text string")
    rows = table(spark, [(1, "x ONLY four, words here y"), (2, "only four other words here"), (3, "One"), (4, "so seven words are one short of eight"), (5, None), (6, "seven words are one short of")])
    got = {(r["doc_id"], r["item_id"], r["n_equal"], r["n_compared"]) for r in decontamination.overlaps(rows, items).collect()}
    assert got == {(1, 1, 4, 4), (3, 2, 1, 1), (4, 3, 7, 7), (4, 2, 1, 1), (6, 2, 1, 1)}
    assert decontamination.overlaps(empty, items).count() == 0


@pytest.mark.parametrize("n", range(1, 8))
def test_short_items_are_found_with_substitutions(spark, n):
    """Every place of every number of substituted tokens: found exactly where four fifths are left."""
    from itertools import combinations

    words = [f"word{i}" for i in range(n)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts, want = [], set()
    for changed in range(n + 1):
        for bad in combinations(range(n), changed):
            if 10 * (n - changed) >= 8 * n:
                want.add((len(texts), n - changed))
            texts.append("before them " + " ".join("other" if i in bad else w for i, w in enumerate(words)) + " after")
    docs = table(spark, list(enumerate(texts)))
    got = {(r["doc_id"], r["n_equal"]) for r in decontamination.overlaps(docs, items).collect()}
    assert got == want and len(want) == (n + 1 if n >= 5 else 1)


@pytest.mark.parametrize("n, changed, least", [(20, 4, 1.0), (20, 3, 1.0), (15, 3, 0.99), (12, 2, 1.0), (10, 2, 0.95), (8, 1, 0.99)])
def test_seeds_survive_substitutions(n, changed, least):
    """The share of all placements of so many substituted tokens that leave some mask whole: what the seeds can find at all."""
    from itertools import combinations

    found = total = 0
    for bad in combinations(range(n), changed):
        total += 1
        found += any(all(c == "0" or at + j not in bad for j, c in enumerate(mask)) for mask in decontamination.MASKS for at in range(n - len(mask) + 1))
    assert found / total >= least


def test_quality_rules(docs, empty):
    rows = quality_rules.judged(docs).collect()
    want = sorted((brute.base_rules(t)[0:6] for _, t in ROWS), key=str)
    assert sorted(((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows), key=str) == want
    kept = brute.kept_hosts([(r["source"], r["text"]) for r in docs.collect()])
    assert sum(kept) == sum(r["kept"] for r in rows)
    assert quality_rules.judged(empty).count() == 0


def test_a_bad_host_rejects_its_documents(spark):
    """Verdicts of hosts, an id on two hosts judged by row, and a host too small to be judged by itself."""
    good, bad = [prose(30) for _ in range(60)], ["## $$ ** word " * 30] * 12
    rows = [(i, t, f"host{i % 3}") for i, t in enumerate(good)] + [(100 + i, t, "spam") for i, t in enumerate(bad)] + [(200, good[0], "spam"), (0, good[1], "spam"), (300, bad[0], "tiny"), (301, good[2], None)]
    df = spark.createDataFrame([(i, t, "en", h, len(t)) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["host_rejected"], r["kept"]) for r in quality_rules.judged(df).collect())
    kept = brute.kept_hosts([(h, t) for _, t, h in rows])
    assert sorted(k for _, _, k in got) == sorted(kept) and ("200", True, False) in got and ("301", False, True) in got
    import corpus_pipeline as C

    left = sorted((r["doc_id"], r["source"]) for r in C.quality(spark, df, "").collect())
    assert left == sorted((i, h) for (i, _, h), k in zip(rows, kept, strict=True) if k and h) + [(301, None)]


@pytest.mark.parametrize("n", [1, 2, 7, 24, 1000])
def test_feistel(n):
    places = [sharding.permute(i, n) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [sharding.row_number_at(p % 5, p // 5, n, 5) for p in places] == list(range(n))


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 7).collect()
    assert [sharding.permute(r["row_no"], len(rows)) for r in rows] == [r["slot"] * 7 + r["shard"] for r in rows]
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(empty, 7).count() == 0


def test_pieces_against_the_library():
    import sentencepiece

    path = pieces.model_path()
    tool, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    signs = "abcdefghinorst éß;\r\n▁ .,xyzQ0日😀"
    texts = ["", None, " ", "  a  b", "a ", "▁▁ a", "\n\nfoo\r\n;\r", "<s> </s> <0x0A> <unk>", "a" * 3000, prose(2000), *("".join(rnd.choice(signs) for _ in range(rnd.randrange(50))) for _ in range(2000))]
    ids = own.encode(texts)
    want = tool.encode([t or "" for t in texts])
    assert [np.frombuffer(i, "<i4").tolist() for i in ids] == want
    assert own.decode(ids) == [tool.decode(w) for w in want]


def test_unigram_viterbi(tmp_path):
    """A hand-made unigram model, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((c, -6.0 - i / 7, 1) for i, c in enumerate("▁abcde")), *((p, -3.0 - i / 3, 1) for i, p in enumerate(["▁a", "ab", "abc", "cde", "▁ab", "de", "bcd", "ea", "▁▁"]))]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    path = str(tmp_path / "u.model")
    Path(path).write_bytes(m.SerializeToString())
    tool, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(path)
    texts = ["", "abcdeabc", "xyz ab", "a  b", *("".join(rnd.choice("abcdex ") for _ in range(rnd.randrange(25))) for _ in range(1000))]
    assert [np.frombuffer(i, "<i4").tolist() for i in own.encode(texts)] == tool.encode(texts)


def test_pieces_frame(docs, empty):
    rows = pieces.encoded(docs, pieces.model_path()).collect()
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in rows) == sorted((-1 if d is None else d or -1, t or "") for d, t in ROWS)
    assert pieces.encoded(empty, pieces.model_path()).count() == 0


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs).collect()
    want = brute.line_dedup(ROWS)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == sorted((str(d), *w) for (d, _), w in zip(ROWS, want, strict=True))
    assert sum(w[1] for w in want) == 12 and "key" in got[0].asDict()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_token_blocks():
    lens = np.random.default_rng(1).integers(0, 300, 500)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    block = token_files.Block(token_files.pack(offsets, np.arange(offsets[-1]) % 40000, 2))
    assert block.offsets().tolist() == offsets.tolist() and all(block.offset(i) == offsets[i] for i in range(501))
    assert block.document(7).tolist() == (np.arange(offsets[7], offsets[8]) % 40000).tolist()
    assert token_files.Block(token_files.pack(np.zeros(1, int), np.empty(0), 2)).n_docs == 0
    for first, last in ((0, 0), (0, 1), (63, 65), (64, 500), (499, 500), (7, 333)):
        assert block.offsets(first, last).tolist() == offsets[first : last + 1].tolist()
    with pytest.raises(ValueError):
        token_files.Block(b"nope" + bytes(60))
    with pytest.raises(ValueError):
        token_files.WordEncoder(token_files.tokenizer_path("byte_bpe_50k.json"))


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(token_files.tokenizer_path())
    path = token_files.shared_path(spark, "t")
    token_files.write(docs, path, token_files.tokenizer_path(), block_ids=500)
    got = token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("start").collect()
    want, start = [], 0
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert list(map(tuple, got)) == want
    odd = ["don't it's we'll", "<|endoftext|>x <|startoftext|>", "½ ² é́ ﬁ ÀÉ!? a'b 3x", "日本 тест"]
    assert [np.frombuffer(x, "<u2").tolist() for x in token_files.WordEncoder(token_files.tokenizer_path()).encode([t.encode() for t in odd])] == [e.ids for e in tool.encode_batch(odd, add_special_tokens=False)]
    path = token_files.shared_path(spark, "t")
    token_files.write(empty, path, token_files.tokenizer_path())
    assert token_files.read(spark, path).count() == 0


def test_suffix_dedup(spark, empty):
    block = prose(150)
    rows = ROWS + [(200, f"{prose(60)} {block} {prose(60)}"), (201, f"{prose(10)}{block}{prose(90)}"), (202, block[7:]), (203, "ab" * 600), (204, prose(300)), (204, None)]
    df = table(spark, rows)
    got = suffix_dedup.without_repeats(df).select("n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats([t for _, t in rows]))
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_loser_tree():
    items = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 12))).encode() for _ in range(400)]
    runs = []
    for k in range(7):
        own = sorted(items[k::7])
        lens, rests = suffix_dedup.front_code(own)
        runs.append([(s, n, k) for s, n in suffix_dedup.decode_run(lens, rests)])
    merged = list(suffix_dedup.LoserTree(runs))
    assert [m[0] for m in merged] == sorted(items)
    assert [m[1] for m in merged[1:]] == [suffix_dedup.common_prefix(a[0], b[0]) for a, b in zip(merged, merged[1:], strict=False)]


def by_hand(text):
    """(paragraph, family, probability) of the paragraphs of one text that the model takes for a licence's, in plain Python."""
    import math
    import re

    classes, weights, bias, heat, _ = licenses.model()
    out = []
    for k, line in enumerate(re.sub(licenses.WRAP, " ", text or "").split("\n")):
        gs = licenses.grams(line)
        if not set(gs) & set(licenses.anchors()):
            continue
        raw = [(b + sum(weights[g][c] for g in gs if g in weights) / math.sqrt(len(gs))) / heat for c, b in enumerate(bias)]
        best = max(range(len(raw)), key=raw.__getitem__)
        if best:
            out.append((k, classes[best], round(1 / sum(math.exp(x - max(raw)) for x in raw), 6)))
    return out


LICENCE_ROWS = [
    (1, "Some text.\nReleased under the MIT License.\nMore."), (2, None), (3, ""), (4, "She lost her driving license on the way home."), (5, "Licensed under CC BY-NC 4.0."),
    (6, "Licensed under the Foo Bar Public License, version 9, with additional terms of the Foo Bar club."), (1, "Some text.\nReleased under the MIT License.\nMore."),
    (7, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files,\nto deal in the Software without restriction.\nAnother line."),
    (8, "Er kam mit dem Zug und ging mit ihr fort."), (9, "X.\n" * 500 + "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
]


def test_licenses(spark, empty):
    got = {(r["doc_id"], r["paragraph"]): r["verdict"] for r in licenses.found(table(spark, LICENCE_ROWS)).collect()}
    assert got[1, 1] == "mit" and got[5, 0] == "cc-by-nc" and got[7, 0] == "mit" and got[9, 500] == "gpl" and not any(k[0] in (2, 3, 4, 8) for k in got)
    assert got[6, 0] == "unknown"  # a licence of no known family is found and not named
    assert licenses.found(empty).count() == 0
    texts = [f"Note: {t}" for of in licenses.NOTICES.values() for t in of[:1]]
    named = {r["doc_id"]: r["family"] for r in licenses.found(table(spark, list(enumerate(texts)))).collect()}
    assert named == dict(enumerate(licenses.NOTICES))


def test_licenses_by_hand(spark):
    """Families and probabilities of every paragraph against the model's own arithmetic, on notices, their unseen variants and whole documents."""
    held = [(100 + i, v) for i, v in enumerate(v for of in licenses.NOTICES.values() for t in of for v in licenses._variants(t)[1])]
    docs = [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = LICENCE_ROWS[:-1] + held + docs
    got = sorted((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 5)) for r in licenses.found(table(spark, rows)).collect())
    assert got == sorted({(d, k, f, round(p, 5)) for d, t in rows for k, f, p in by_hand(t)})


def test_unseen_variants_are_named():
    """Held-out accuracy of the fit: variants that only the calibration saw."""
    right = total = 0
    for family, of in licenses.NOTICES.items():
        for t in of:
            for v in licenses._variants(t)[1]:
                found = by_hand(v.replace("\n", " "))
                total += 1
                right += bool(found) and found[0][1] == family
    assert total > 100 and right / total > 0.9
    assert not any(by_hand(v) for t in licenses.ORDINARY for v in licenses._variants(t)[0] if "Copyright" not in v)


def test_near_duplicates(docs, empty):
    for words, share in ((3, 85), (5, 80)):
        got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, words, share / 100).collect()}
        want = brute.near([(d, t) for d, t in ROWS if d is not None], words, share)
        assert {k: v for k, v in got.items() if k[0] is not None} == {(d, n): (c, c == d) for d, (n, c) in want.items()}
        assert all(kept for (d, _), (_, kept) in got.items() if d is None)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_larger(spark):
    seeds = [prose(90) for _ in range(12)]
    rows = []
    for i in range(400):
        w = seeds[i % 12].split()
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(table(spark, rows), 3, 0.85).collect()}
    assert got == brute.near(rows, 3, 85)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(chain.limit(0)).count() == 0


def test_bradley_terry(spark, docs, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = bradley_terry.scored(big, bradley_terry.train(big, labels)).join(labels, "doc_id").filter("held_out").collect()
    right = {q: [r["predicted"] == q for r in rows if r["quality"] == q] for q in (0, 1)}
    assert len(rows) > 50 and all(len(x) > 5 and sum(x) / len(x) > 0.9 for x in right.values())  # of either label
    ranker = bradley_terry.train(docs, labels.limit(0))
    out = bradley_terry.scored(docs, ranker).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert bradley_terry.scored(empty, ranker).count() == 0


def test_bradley_terry_by_hand(spark):
    """The fit against plain gradient descent on the pairwise loss, held-out rows and scores against their definitions."""
    import zlib

    rnd_ = np.random.default_rng(3)
    x = rnd_.normal(size=(60, len(bradley_terry.FEATURES)))
    label = (x[:, 0] + 0.5 * x[:, 1] + rnd_.normal(scale=0.7, size=60) > 0.3).astype(int)
    ranker = bradley_terry.fit(x, label)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    pairs = np.array([z[i] - z[j] for i in np.flatnonzero(label == 1) for j in np.flatnonzero(label == 0)])
    w = np.zeros(z.shape[1])
    for _ in range(20000):
        w += 0.5 * ((pairs / (1 + np.exp(pairs @ w))[:, None]).mean(0) - 1e-3 * w)
    assert np.allclose(w, ranker.weights, atol=1e-3)
    s = ((x - x.mean(0)) / x.std(0)) @ ranker.weights
    assert ranker.threshold == pytest.approx(np.quantile(s, (label == 0).mean()))
    assert ((ranker.score(x) >= bradley_terry.CUT) == (s >= ranker.threshold)).all()
    rows = [(i, prose(5 + i % 30) + " #!" * (i % 7)) for i in range(200)] + [(500, None), (501, "")]
    got = {r["doc_id"]: r for r in bradley_terry.scored(table(spark, rows), ranker).collect()}
    for i, t in rows:
        want = float(ranker.score(np.array([bradley_terry.features((t or "").encode())]))[0])
        assert got[i]["score"] == pytest.approx(want) and got[i]["predicted"] == (want >= 0.3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_a_repeated_id_is_learned_once(spark):
    """Rows that repeat a labelled id do not add to what the fit collects."""
    rows = [(i, prose(40) if i % 2 else "x " * (5 + i)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, often = (bradley_terry.train(table(spark, r), labels) for r in (rows, rows * 3))
    assert np.allclose(once.weights, often.weights)


def test_pipeline(spark, tmp_path):
    """Every stage of the pipeline against plain Python over the smallest documents."""
    import corpus_pipeline as C
    import sentencepiece

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(rows)
    ids = [i for i, k in zip(ids, brute.kept_hosts([rows[i] for i in ids]), strict=True) if k]
    lines = brute.line_dedup([(i, rows[i][1]) for i in ids])
    text = {i: t for i, (_, n, t) in zip(ids, lines, strict=True) if not n or t.strip(brute.SPACE)}
    text = {i: text[i] for i, (_, c) in brute.near(list(text.items()), 5, 80).items() if c == i}
    text = {i: t for i, t in text.items() if not brute.leaks(t, items)}
    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = {i: tool.encode(t) for i, t in text.items()}
    out = C.run(spark, SF).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<i4").tolist() for r in out} == want
    assert all(r["exact"] for r in out) and [len(C.STAGES), C.ORACLE_SQL] == [5, None]
