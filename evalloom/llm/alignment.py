"""Alignment of two tokenizers' tokens over the bytes that both spell.

Tokens of the one (A) are intervals of a text's bytes, and so are those of the
other (B). B's intervals form a static index, two sorted arrays of starts and
ends; each token of A stabs it by bisection and gets the tokens of B that it
overlaps. Offsets where tokens of both end are the gaps that no token spans:
they cut the tokens into groups.

Neither tokenizer joins a word to the space before the next one, so texts are
cut at single spaces and each distinct word is aligned once, many in one pass
of numpy; a document's results are sums and joins of its words'.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.llm.common import checkpointed, drop_shuffles, python_ready
from evalloom.llm.token_files import shared_path

#: A word ends before a space that stands alone to its left and has a sign to its right.
_CUT = re.compile("(?<=[^ ▁]) (?=\\S)")
#: Memory for the words that a Python worker has met since it last began anew (those of the time before are kept as long), and what an entry takes beside its texts.
CACHE_BYTES, ENTRY_BYTES = 96_000_000, 360
#: Text that is aligned at once; batches beyond are cut.
BATCH_BYTES = 4_000_000
#: A pair's code is A's id shifted by this, plus B's id.
SHIFT = 24
#: Pairs that are broadcast at most (17 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 500_000


def tokenizer_paths(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


class _Spelling:
    """The bytes of each id."""

    def __init__(self, spelled: list[bytes]):
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Aligner:
    """Byte-level BPE of the tokenizers library against a SentencePiece model with a space before each text.

    PROBES hold both files to what the cuts between words need; other files are refused.
    """

    PROBES = ("a  b c", " x\n\n y", "one two\tthree \n four", "it's 42nd, don't! (see) \"q\"", "a b éÀ 日本 x  y", "end ", "a\n", "\u0001 \u0000 z", "x <|endoftext|> <s> </s> y")

    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [k for k in range(256) if k not in printable]
        byte = {chr(k): k for k in printable} | {chr(256 + k): x for k, x in enumerate(rest)}  # the byte-level alphabet
        vocabulary = {i: w for w, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = _Spelling([bytes(byte[c] for c in vocabulary[i]) if all(c in byte for c in vocabulary.get(i, " ")) else b"" for i in range(self.a.get_vocab_size())])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = _Spelling([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.words: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}
        self.held = 0
        for text in self.PROBES:
            for whole, parts in zip(self.encode([text]), self.encode(_CUT.split(text)), strict=True):
                if whole[0] != [i for p in parts for i in p]:
                    raise ValueError(f"{a} or {b} joins words")

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of a space and each word, B's of each word."""
        return [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)], self.b.encode(words, num_threads=1)

    def _learn(self, words: list[str]) -> None:
        both = self.encode(words)
        raw = [b" " + w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, counts, good = [], [], np.ones(len(words), bool)
        for found, spelling in zip(both, (self.a_bytes, self.b_bytes), strict=True):
            flat, n = np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))
            ids.append(flat)
            counts.append(n)
            ends = np.concatenate([[0], np.cumsum(spelling.sizes[flat])])[np.cumsum(n)]
            data = spelling.join(flat)
            if np.array_equal(np.diff(ends, prepend=0), size):
                differs = np.frombuffer(data, np.uint8) != np.frombuffer(b"".join(raw), np.uint8)
                good &= ~np.logical_or.reduceat(differs, ends - size)
            else:
                good &= [data[s:e] == r for s, e, r in zip([0, *ends.tolist()], ends.tolist(), raw, strict=False)]
        for k in np.flatnonzero(~good).tolist():
            self._keep(words[k], (0, 0, 0, 0, b"", b"", False))
        ids = [i[np.repeat(good, n)] for i, n in zip(ids, counts, strict=True)]
        counts, words = [n[good] for n in counts], [w for w, ok in zip(words, good.tolist(), strict=True) if ok]
        a_end, b_end = (np.cumsum(s.sizes[i]) for s, i in zip((self.a_bytes, self.b_bytes), ids, strict=True))
        a_start, b_start = a_end - self.a_bytes.sizes[ids[0]], b_end - self.b_bytes.sizes[ids[1]]
        first, after = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        n = after - first
        of = np.repeat(np.arange(len(n)), n)
        pairs = ids[0][of] << SHIFT | ids[1][np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(of))]
        gaps = np.intersect1d(a_end, b_end, assume_unique=True)
        cut_a, cut_b = (np.searchsorted(x, gaps, "right").tolist() for x in (a_end, b_end))
        text_a, text_b = (list(map(str, i.tolist())) for i in ids)
        groups, x, y = [], 0, 0
        for p, q in zip(cut_a, cut_b, strict=True):
            groups.append(f"{text_a[x] if p == x + 1 else ','.join(text_a[x:p])}|{text_b[y] if q == y + 1 else ','.join(text_b[y:q])}")
            x, y = p, q
        # tokens of A, gaps and links before each word
        a_at = np.concatenate([[0], np.cumsum(counts[0])])
        gap_at = np.searchsorted(gaps, np.concatenate([[0], a_end])[a_at], "right")
        link_at = np.concatenate([[0], np.cumsum(n)])[a_at]
        data, spots, cuts = pairs.tobytes(), (8 * link_at).tolist(), gap_at.tolist()
        numbers = zip(counts[0].tolist(), counts[1].tolist(), np.diff(gap_at).tolist(), np.diff(link_at).tolist(), strict=True)
        for j, (w, four) in enumerate(zip(words, numbers, strict=True)):
            self._keep(w, (*four, ";".join(groups[cuts[j] : cuts[j + 1]]).encode(), data[spots[j] : spots[j + 1]], True))

    def _keep(self, word: str, entry: tuple) -> None:
        self.words[word] = entry
        self.held += ENTRY_BYTES + len(word) + len(entry[4]) + len(entry[5])

    def forget(self) -> None:
        self.words, self.before, self.held = {}, {}, 0

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Columns of one row for each text."""
        if self.held > CACHE_BYTES:
            self.before, self.words, self.held = self.words, {}, 0
        split = [_CUT.split(t) if t else [] for t in texts]
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64)
        new = [w for w in number if w not in self.words]
        for w in new:
            if w in self.before:
                self._keep(w, self.before[w])
        new = [w for w in new if w not in self.words]
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        entries = [self.words[w] for w in number]
        ends = np.cumsum([0] + [len(x) for x in split])
        good = np.array([e[6] for e in entries], bool)
        bad = np.concatenate([[0], np.cumsum(~good[at])]) if len(at) else np.zeros(1, np.int64)
        whole = (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1])
        out: dict[str, pa.Array] = {}
        for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            sums = np.concatenate([[0], np.cumsum(np.array([e[k] for e in entries], np.int64)[at])])
            out[name] = pa.array(np.where(whole, sums[ends[1:]] - sums[ends[:-1]], 0))
        out["groups"] = pa.array([b";".join([self.words[w][4] for w in words]).decode() if ok else "" for words, ok in zip(split, whole.tolist(), strict=True)])
        # each document's words, then the pairs of these, with how often
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        use = whole[doc]
        key, times = np.unique(doc[use] * max(1, len(entries)) + at[use], return_counts=True)
        doc, word = key // max(1, len(entries)), key % max(1, len(entries))
        size = np.array([len(e[5]) // 8 for e in entries], np.int64)
        start = np.cumsum(size) - size
        codes, flat = np.unique(np.frombuffer(b"".join([e[5] for e in entries]), np.int64), return_inverse=True)
        n = size[word]
        spot = np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, times = np.repeat(doc, n) * max(1, len(codes)) + flat[spot], np.repeat(times, n)
        order = np.argsort(key)
        key, times = key[order], times[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        key, total = key[begins], np.add.reduceat(times, begins) if len(begins) else times
        rows = np.searchsorted(key // max(1, len(codes)), np.arange(len(texts) + 1)).astype(np.int32)
        links = pa.StructArray.from_arrays([pa.array(codes[key % max(1, len(codes))] if len(key) else np.zeros(0, np.int64)), pa.array(total)], names=["pair", "n"])
        out["links"] = pa.ListArray.from_arrays(pa.array(rows), links)
        return out


@functools.lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, _row (a number of its own), n_a, n_b, n_groups, n_links, groups and links of every row.

    ``groups`` has A's and B's ids as ``a1,a2|b1;a3|b2,b3``; ``links`` each
    (pair, n): A's id shifted by ``SHIFT`` plus B's id, and how often their tokens
    overlap. ``a`` and ``b`` are opened on the executors. Texts that are null or
    empty, or whose joined tokens differ from a space and the text, have no
    tokens: zeros, '' and no links. Rows are neither merged nor reordered, so a
    repeated id is aligned again; an empty table gives no rows.
    """
    python_ready(docs.sparkSession, 1024)
    names = ["doc_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, row = aligner(a, b), TaskContext.get().partitionId() << 40
        try:
            for batch in batches:
                step = max(1, int(batch.num_rows * min(1.0, BATCH_BYTES / max(1, batch.nbytes))))
                for k in range(0, batch.num_rows, step):
                    part = batch.slice(k, step)
                    found = tool.align(part.column("text").to_pylist())
                    number = pa.array(np.arange(row, row + part.num_rows))
                    row += part.num_rows
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), number, *(found[c] for c in names[2:])], names=names)
        finally:
            tool.forget()  # the worker goes on with other tasks, which need the memory

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _row long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: long, n: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no pair of the same A has more). A's pairs number B's vocabulary at most."""
    found = rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    return found.select("pair", "count", (F.col("count") == most).alias("best"))


def scored(rows: DataFrame) -> DataFrame:
    """The rows of ``groups`` (without their text, unless it is kept), with n_best and count_sum in place of the links.

    They are written to the shared folder first: texts are encoded once. Counts
    of pairs are joined with each row's distinct pairs, by a broadcast where they
    number ``BROADCAST_PAIRS`` at most and by a shuffle else, and summed up by row.
    """
    spark = rows.sparkSession
    drop_shuffles(spark)
    path = shared_path(spark, "alignments")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    counts = checkpointed(pair_counts(rows))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    each = rows.select("_row", F.inline("links")).join(counts, "pair")
    sums = each.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("links").join(sums, "_row", "left").select(*[c for c in rows.columns if c not in ("links", "_row")], *zero)
