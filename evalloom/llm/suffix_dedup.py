"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

Every ``length``-byte window belongs to one anchor, the position of the least
32-byte hash among its first 256 positions; equal windows have their anchors at
equal distances, so only suffixes at anchors (one in some 128) take part.

1. Distinguishing: an anchor whose right context no other anchor has, up to the
   bytes that all its windows share, has no repeated window. Anchors with equal
   contexts all around are one class; if a class has several members, all its
   windows are repeated.
2. Sorting: one suffix of each class that shares its right context with other
   classes is sorted: every task sorts and front-codes a run for each range of
   suffixes, the runs are exchanged, and each range merges its runs with a
   loser tree whose nodes keep common-prefix lengths, so that known prefixes
   are never compared again.
3. In the merged order the suffixes of one group (common prefixes as long as
   the bytes that all windows share) are neighbours. Windows that two suffixes
   of a group have in common are repeated. A group that reaches a range's border
   may go on in the next range; its windows are matched by their hashes through
   a shuffle with map-side counts, however large the group is.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.llm.common import checkpointed, python_ready, shuffle_partitions

LENGTH = 400
SPREAD, GRAM = 256, 32
#: Suffixes that are looked at for the borders of ranges, whatever the input's size.
SAMPLE = 2000
#: Suffixes that a task sorts into one run.
RUN_BYTES = 48_000_000
_POS_BITS = 24
#: Text that is anchored at once; positions have to fit into ``_POS_BITS``.
_BUFFER = 4_000_000

_state = 88172645463325252
_table = []
for _ in range(256):  # byte values by an xorshift generator
    _state ^= _state << 13 & (1 << 64) - 1
    _state ^= _state >> 7
    _state ^= _state << 17 & (1 << 64) - 1
    _table.append(_state)
_BYTE = np.array(_table, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def anchors(texts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its anchors as (position, least distance, greatest distance) of the windows that belong to them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    total = int(starts[-1])
    none = (np.empty(0, np.int64),) * 3
    if total < length:
        return [none] * len(texts)
    if total >= 1 << _POS_BITS and len(texts) > 1:
        half = len(texts) // 2
        return anchors(texts[:half], length) + anchors(texts[half:], length)
    h, m = _BYTE[np.frombuffer(b"".join(texts), np.uint8)], 1
    while m < GRAM:
        h = _mix(h[:-m]) + h[m:]
        m *= 2
    low = np.uint64((1 << max(_POS_BITS, total.bit_length())) - 1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last one
    m = 1
    while m < SPREAD:
        key = np.minimum(key[:-m], key[m:])
        m *= 2
    first = (low - (key & low)).astype(np.int64)
    out = []
    for s, n in zip(starts[:-1].tolist(), sizes.tolist(), strict=True):
        if n < length:
            out.append(none)
            continue
        own = first[s : s + n - length + 1] - s
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(own)]]) - 1
        at = own[begin]
        out.append((at, at - end, at - begin))
    return out


def _in_pieces(texts: list[bytes]):
    """Index ranges of texts with about ``_BUFFER`` bytes."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _BUFFER:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    yield begin, len(texts)


def _anchor_rows(length: int):
    shared = length - SPREAD + 1

    def run(batches):
        for batch in batches:
            rows, texts = batch.column("_row").to_pylist(), [t or b"" for t in batch.column("_bytes").to_pylist()]
            out: list[list[int]] = [[], [], [], []]
            for i, j in _in_pieces(texts):
                for row, text, (at, lo, hi) in zip(rows[i:j], texts[i:j], anchors(texts[i:j], length), strict=True):
                    view = memoryview(text)
                    for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        out[0].append(xxhash.xxh3_64_intdigest(view[a : a + shared]) - (1 << 63))
                        out[1].append(xxhash.xxh3_64_intdigest(view[a - y : a - x + length], x << 9 | y) - (1 << 63))
                        out[2].append(row)
                        out[3].append(a << 18 | x << 9 | y)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["right", "around", "_row", "spot"])

    return run


def _unpack(spot: int) -> tuple[int, int, int]:
    return spot >> 18, spot >> 9 & 511, spot & 511


# --- runs of suffixes


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need not be compared."""
    n = min(len(a), len(b))
    step, i = 16, known
    while i < n:
        j = min(n, i + step)
        if a[i:j] != b[i:j]:
            while a[i] == b[i]:
                i += 1
            return i
        i, step = j, step * 2
    return n


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common-prefix lengths with the suffix before, and the rests, of sorted suffixes."""
    lens, rests, before = [], [], b""
    for s in suffixes:
        n = common_prefix(before, s)
        lens.append(n)
        rests.append(s[n:])
        before = s
    return lens, rests


def decode_run(lens, rests):
    """(suffix, common-prefix length with the one before) in order."""
    before = b""
    for n, rest in zip(lens, rests, strict=True):
        before = before[:n] + rest
        yield before, n


class LoserTree:
    """Merges sorted runs of (suffix, lcp with the one before in its run, item).

    Each node keeps the loser of its match and the loser's common prefix with
    the winner that passed. The next challenger comes from the last winner's
    run, so all lengths on its path are relative to the same last output: of two
    with different lengths the longer wins without looking at a byte, and equal
    lengths are compared from that length on.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < len(self.runs):
            self.size *= 2
        self.head: list = [None] * self.size
        self.lcp = [0] * self.size
        for k in range(len(self.runs)):
            self._advance(k)
        self.node = [-1] * self.size
        self.winner = self._build(1) if self.size > 1 else 0

    def _advance(self, k: int) -> None:
        got = next(self.runs[k], None) if k < len(self.runs) else None
        self.head[k] = got
        self.lcp[k] = got[1] if got else -1

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes that with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)  # the lengths with the winner are the smaller ones already
        n = common_prefix(x[0], y[0], self.lcp[a])
        s, t = x[0], y[0]
        smaller = len(s) <= len(t) if n == min(len(s), len(t)) else s[n] < t[n]
        if smaller:
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def _build(self, k: int) -> int:
        if k >= self.size:
            leaf = k - self.size
            if self.head[leaf]:
                self.lcp[leaf] = 0  # nothing has been put out yet
            return leaf
        win, lose = self._match(self._build(2 * k), self._build(2 * k + 1))
        self.node[k] = lose
        return win

    def __iter__(self):
        """(suffix, lcp with the suffix put out before, item) in order."""
        while self.head[self.winner] is not None:
            w = self.winner
            yield self.head[w][0], self.lcp[w], self.head[w][2]
            self._advance(w)
            k = (w + self.size) // 2
            while k:
                win, lose = self._match(w, self.node[k])
                self.node[k] = lose
                w = win
                k //= 2
            self.winner = w


def _runs(length: int, borders: list[tuple[bytes, bytes]]):
    """Each task's suffixes as sorted, front-coded runs, one row for each range; beyond ``RUN_BYTES`` a task begins new runs."""

    def run(batches):
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0

        def flush(items):
            items.sort()
            cuts = [0, *(bisect.bisect_left(items, b) for b in borders), len(items)]
            out: dict[str, list] = {c: [] for c in ("range", "run", "lens", "rests", "lefts", "rows", "spots")}
            for r in range(len(cuts) - 1):
                own = items[cuts[r] : cuts[r + 1]]
                if own:
                    lens, rests = front_code([i[0] for i in own])
                    for name, value in zip(out, (r, task << 20 | part, lens, b"".join(rests), [i[1] for i in own], [i[2] for i in own], [i[3] for i in own]), strict=True):
                        out[name].append(value)
            return pa.RecordBatch.from_pydict(out, _RUN_SCHEMA)

        items, held = [], 0
        for batch in batches:
            for row, text, spots in zip(*(batch.column(c).to_pylist() for c in ("_row", "_bytes", "spots")), strict=True):
                for s in spots:
                    a, x, y = _unpack(s)
                    items.append((text[a : a - x + length], text[a - y : a], row, s))
                    held += length + y
            if held > RUN_BYTES:
                yield flush(items)
                items, held, part = [], 0, part + 1
        if items:
            yield flush(items)

    return run


_RUN_SCHEMA = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("lens", pa.list_(pa.int32())), ("rests", pa.binary()), ("lefts", pa.list_(pa.binary())), ("rows", pa.list_(pa.int64())), ("spots", pa.list_(pa.int64()))])
_RUN_DDL = "range int, run long, lens array<int>, rests binary, lefts array<binary>, rows array<long>, spots array<long>"


def _windows(text: bytes, n: int, length: int) -> np.ndarray:
    """Hashes of the first ``n`` windows of ``text``."""
    h, m, acc, off = _BYTE[np.frombuffer(text, np.uint8)], 1, None, 0
    bits = length
    with np.errstate(over="ignore"):
        while True:
            if bits & 1:
                acc = h if acc is None else _mix(acc[: len(h) - off]) + h[off:]
                off += m
            bits >>= 1
            if not bits:
                return acc[:n]
            h = _mix(h[:-m]) + h[m:]
            m *= 2


def _merged(length: int):
    """Merge a range's runs; (row, from, to) of repeated windows' bytes, or the windows of groups at the range's borders."""
    shared = length - SPREAD + 1

    def settle(group, outer: bool, out):
        hashes, owner, starts = [], [], []
        for k, (suffix, left, _, s) in enumerate(group):
            a, x, y = _unpack(s)
            hashes.append(_windows(left + suffix, y - x + 1, length))
            owner.append(np.full(y - x + 1, k))
            starts.append(np.arange(a - y, a - x + 1))
        h, owner, at = np.concatenate(hashes), np.concatenate(owner), np.concatenate(starts)
        rows = np.array([g[2] for g in group], np.int64)[owner]
        if outer:
            out["row"].append(rows)
            out["at"].append(at)
            out["window"].append(h.view(np.int64))
            return
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        out["row"].append(rows[twice])
        out["at"].append(at[twice])
        out["window"].append(np.full(int(twice.sum()), -1, np.int64))

    def decoded(r):
        """The run's suffixes as they are asked for: of each run only one stands decoded."""
        cuts = [0, *r["ends"]]
        rests = (r["rests"][a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        for (s, n), left, row, spot in zip(decode_run(r["lens"], rests), r["lefts"], r["rows"], r["spots"], strict=True):
            yield s, n, (left, row, spot)

    def merge(runs):
        out = {"row": [], "at": [], "window": []}
        group, outer = [], True
        for suffix, n, (left, row, spot) in LoserTree([decoded(r) for r in runs]):
            if group and n < shared:
                if outer or len(group) > 1:
                    settle(group, outer, out)
                group, outer = [], False
            group.append((suffix, left, row, spot))
        if group:
            settle(group, True, out)  # it may go on in the next range
        if not out["row"]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[c])) for c in out], names=list(out))

    def run(batches):
        now, runs = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != now and runs:
                    if (got := merge(runs)) is not None:
                        yield got
                    runs = []
                now = r["range"]
                whole = [length - (s >> 9 & 511) for s in r["spots"]]
                r["ends"] = np.cumsum([w - n for w, n in zip(whole, r["lens"], strict=True)]).tolist()
                runs.append(r)
        if runs and (got := merge(runs)) is not None:
            yield got

    return run


def _apply(kind):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("_bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                runs: list[list[int]] = []
                for s in sorted((s["lo"], s["hi"]) for s in spans or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                for column, value in zip(out, (len(text), len(text) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            arrays = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int64()))), pa.array(out[3], pa.binary()), pa.array(out[4])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return run


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_row, spans) of the texts that have repeated bytes: [lo, hi) of covered bytes, unordered and apart.

    ``_row`` is the hash of id and text. A repeated row repeats its whole text.
    ``length`` must be at least the 287 bytes that an anchor needs and at most 511 + 256.
    """
    spark = docs.sparkSession
    python_ready(spark)
    slim = docs.select(F.xxhash64("doc_id", "text", F.octet_length("text")).alias("_row"), F.col("text").cast("binary").alias("_bytes"))
    spots = slim.filter(F.octet_length("_bytes") >= length).mapInArrow(_anchor_rows(length), "right long, around long, _row long, spot long")
    spots = checkpointed(spots)
    # written before each join, so that both sides are plain shuffles and a hot context's rows can be split
    several = checkpointed(spots.groupBy("right").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("right"))
    likely = checkpointed(spots.join(several, "right"))
    classes = likely.groupBy("right", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "spot")).alias("rep"))
    classes = checkpointed(classes)
    copied = classes.filter("n > 1").select("right", "around")
    at = F.shiftright("spot", 18)
    begin = at - F.col("spot").bitwiseAND(F.lit(511))
    end = at - F.shiftright("spot", 9).bitwiseAND(F.lit(511)) + length
    whole = likely.join(copied, ["right", "around"], "left_semi").select("_row", begin.alias("lo"), end.alias("hi"))

    mixed = checkpointed(classes.groupBy("right").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("right"))
    reps = checkpointed(classes.join(mixed, "right", "left_semi").select("n", "rep._row", "rep.spot"))
    # borders from a bounded sample of suffixes
    sample = reps.orderBy(F.xxhash64("_row", "spot")).limit(SAMPLE)
    sampled = sample.select("_row", "spot")
    place = F.shiftright("spot", 18).cast("int")
    near, far = F.shiftright("spot", 9).bitwiseAND(F.lit(511)).cast("int"), F.col("spot").bitwiseAND(F.lit(511)).cast("int")
    suffix, left = F.col("_bytes").substr(place + 1, F.lit(length) - near), F.col("_bytes").substr(place - far + 1, far)
    seen = slim.join(F.broadcast(sampled), "_row").select(suffix.alias("s"), left.alias("l")).distinct()
    found = sorted((bytes(r["s"]), bytes(r["l"])) for r in seen.collect())
    ranges = shuffle_partitions(spark)
    borders = sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []
    wanted = reps.groupBy("_row").agg(F.collect_list("spot").alias("spots"))
    texts = slim.join(wanted.withColumnRenamed("_row", "_w").hint("shuffle_hash"), F.col("_row") == F.col("_w")).select("_row", "_bytes", "spots")
    runs = texts.mapInArrow(_runs(length, borders), _RUN_DDL)
    dealt = runs.repartition(ranges, "range").sortWithinPartitions("range", "run")
    hits = checkpointed(dealt.mapInArrow(_merged(length), "row long, at long, window long"))
    border = hits.filter("window <> -1")
    twice = border.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("window")
    marked = hits.filter("window = -1").select("row", "at").unionByName(border.join(twice, "window", "left_semi").select("row", "at"))
    partly = marked.select(F.col("row").alias("_row"), F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    # spans that touch are one before they are collected: a text of one letter has a window at every byte
    order = Window.partitionBy("_row").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = whole.unionByName(partly).withColumn("_new", (reached.isNull() | (F.col("lo") > reached)).cast("int"))
    runs = apart.withColumn("_run", F.sum("_new").over(order)).groupBy("_row", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (sorted, disjoint), kept (bytes) and kept_sha256 of every row.

    A byte is removed if a ``length``-byte string that covers it also starts
    anywhere else; strings do not cross documents and are judged on the input.
    What is left may be cut inside a character, so it is returned as bytes. Null
    and empty texts and texts shorter than ``length`` lose nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = repeated(docs, length).withColumnRenamed("_row", "_m")
    base = docs.select("doc_id", F.xxhash64("doc_id", "text", F.octet_length("text")).alias("_row"), F.col("text").cast("binary").alias("_bytes"))
    both = base.join(marks.hint("shuffle_hash"), F.col("_row") == F.col("_m"), "left").select("doc_id", "_bytes", "spans")
    return both.mapInArrow(_apply(kind), f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string")
