"""Near-duplicate documents by bottom-k sketches.

One hash function orders all word shingles. A document keeps its smallest
``k`` values as its sketch; documents with equal shingle sets are one class.
Inverted lists of retained values generate candidates: a pair over the
threshold has nearly all of its joint sketch in common, at least the floor of
:func:`required` of it, so each of the two shares its rarest retained values,
few enough that the required number would not fit without them (a prefix by
document frequency). Values that no other class has generate nothing, however
common the rest. Within a list every class meets the list's most typical
class; classes of lists that still fall apart meet each other in the join
condition, which bounds what they share by parities of their values. The estimate from the joint sketch filters pairs, the exact Jaccard
similarity of the full sets verifies them, and components follow.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import checkpointed, python_ready
from evalloom.llm.components import components

K = 64
#: Retained values by which classes of one list that nothing has joined yet are compared; sets up to this size are compared whole.
WIDE = 256
#: Longs of parities by which the values that two classes share are bounded.
PARITIES = 12
#: Classes of a residual list that are compared with as many others of the list at once.
BLOCK_CLASSES = 256
#: Keys of documents to verify that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 4_000_000
#: Bytes whose words are hashed at once.
BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
_VALUE = (_VALUE ^ (_VALUE >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
_VALUE[65:91] = _VALUE[97:123]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and starts of the words in bytes that end in white space, A-Z lower-cased; a block of bytes at a time."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        space = _SPACE[data[at:end]]
        while not space.any():  # a word longer than a block
            end = min(len(data), at + 2 * (end - at))
            space = _SPACE[data[at:end]]
        space = space[: len(space) - int(space[::-1].argmax())]
        here = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        if not space[0]:
            here = np.concatenate([[0], here])
        if len(here):
            ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
            sizes = ends - here
            # each byte's value by its place in its word; words lie side by side
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            powers = _BASE ** np.arange(int(sizes.max()), dtype=np.uint64)
            values = _VALUE[data[at : at + len(space)][~space]] * powers[place]
            h = np.add.reduceat(values, np.cumsum(sizes) - sizes)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(h ^ (h >> np.uint64(32)))
            starts.append(here + at)
        at += len(space)
    none = np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else none.astype(np.uint64), np.concatenate(starts) if starts else none


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the ``words``-word shingles of each text, A-Z lower-cased.

    A shorter text has its whole sequence of words as its one shingle, a text
    without words none. Nothing is kept from one call to the next.
    """
    if not texts:
        return []
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    h, starts = word_hashes(data)
    begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    cuts = np.searchsorted(starts, begins).tolist()

    def mixed(size: int, h: np.ndarray) -> np.ndarray:
        n = len(h) - size + 1
        x = np.full(n, size, np.uint64)
        for j in range(size):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : j + n]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(1)  # 63 bits: not negative as a long

    every = mixed(words, h) if len(h) >= words else h[:0]
    sets = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        x = every[a : b - words + 1].copy() if b - a >= words else mixed(b - a, h[a:b]) if b > a else h[:0]
        x.sort()
        sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return sets


def signatures(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, _row (hash of the text), n_shingles, digest (of the set, null if empty) and sketch of every row."""
    python_ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("_bytes").to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("_row"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "_row", "n_shingles", "digest", "sketch"],
            )

    slim = docs.select("doc_id", F.xxhash64("text").alias("_row"), F.col("text").cast("binary").alias("_bytes"))
    return slim.mapInArrow(run, f"doc_id {kind}, _row long, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, keys: DataFrame, words: int, most: int | None = None) -> DataFrame:
    """node, digest, n and shingles (the ``most`` smallest, or all) of the documents that ``keys`` (_id, _key, node, digest) names."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("_bytes").to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:most].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["node", "digest", "n", "shingles"],
            )

    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_row"), F.col("text").cast("binary").alias("_bytes"))
    rows = rows.join(keys, (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "digest", "_bytes")
    return rows.mapInArrow(run, "node long, digest binary, n long, shingles array<long>")


def marks(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """node, marks and twice of the documents that ``keys`` names: what classes of one list are compared by.

    Marks are the upper 32 of the 63 bits of the ``WIDE`` smallest shingles, in
    their order and half their size. Unequal shingles may have one mark, so
    marks in common are at least the shingles in common but for repeated marks,
    of which ``twice`` tells the number.
    """
    cut = full_sets(docs, keys, words, WIDE).dropDuplicates(["node"])
    # all but the sign bit of an int, and then the sign
    mark = F.transform("shingles", lambda x: (F.shiftright(x, 31) - F.lit(1 << 31)).cast("int"))
    return cut.select("node", mark.alias("marks")).withColumn("twice", F.size("marks") - F.size(F.array_distinct("marks")))


def parities(marked: DataFrame) -> DataFrame:
    """node, twice, distinct (marks) and ``PARITIES`` longs p0, p1, ... of the rows of :func:`marks`.

    Each distinct mark flips one bit. Marks of both of two classes leave no
    difference, so no more bits differ than marks stand in one class only.
    """
    size = 64 * PARITIES

    def run(batches):
        for batch in batches:
            lists, n = batch.column("marks"), batch.num_rows
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            own = np.unique(row << 32 | lists.flatten().to_numpy().view(np.uint32).astype(np.int64))
            row, mark = own >> 32, own & 0xFFFFFFFF
            bits = (np.bincount(row * size + mark % size, minlength=n * size) & 1).astype(np.uint8)
            longs = np.packbits(bits).view(np.int64).reshape(n, PARITIES).T
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("twice"), pa.array(np.bincount(row, minlength=n), pa.int32()), *map(pa.array, longs)], names=names)

    names = ["node", "twice", "distinct", *[f"p{i}" for i in range(PARITIES)]]
    return marked.mapInArrow(run, "node long, twice int, distinct int" + "".join(f", p{i} long" for i in range(PARITIES)))


def most_shared(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Shingles among the ``WIDE`` smallest that two rows of :func:`parities` can have in common at most."""
    apart = reduce(add, [F.bit_count(a(f"p{i}").bitwiseXOR(b(f"p{i}"))) for i in range(PARITIES)])
    return F.shiftright(a("distinct") + b("distinct") - apart, 1) + F.least(a("twice"), b("twice"))


def met_in_cells(side: DataFrame, on: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of one list for which ``on`` holds of the two rows of ``side`` (value, blocks, node, ...).

    A list is dealt in blocks, and each two of them meet in a cell of their own.
    Both sides of the join read the same rows, so one shuffle serves both.
    """
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    cells = side.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *[c for c in cells.columns if c not in ("other", "blocks")])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    # without nulls the condition's code is short enough for the JVM to compile, which leaves methods of over 8000 bytes to its interpreter
    cells = cells.filter(reduce(and_, [F.col(c).isNotNull() for c in cells.columns]))
    here = [a(c) == b(c) for c in ("value", "lo", "hi")] + [a("node") < b("node"), (a("lo") == a("hi")) | (a("own") != b("own")), on(a, b)]
    return cells.alias("a").join(cells.alias("b"), reduce(and_, here)).select(a("node").alias("a"), b("node").alias("b"))


def required(size: Column, threshold: float, k: int) -> Column:
    """Retained values that a class of so many has to share with a partner.

    Of the k smallest values of two sets' union each is shared with probability
    ``threshold`` or more; the floor lies 5.5 standard deviations below. Sets of
    fewer than k values are known whole, and have to share their part of them.
    """
    floor = math.floor(k * threshold - 5.5 * math.sqrt(k * threshold * (1 - threshold)))
    return F.least(F.ceil(size * F.lit(threshold) - 1e-9), F.lit(floor)).cast("int")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, k: int = K) -> DataFrame:
    """doc_id, _row (hash of the text), n_shingles, component_id and kept of every row.

    component_id is the smallest doc_id of the component of links with Jaccard
    similarity of at least ``threshold`` (in hundredths); kept marks the row
    with that id. Texts without words link with nothing. Rows with a null id
    belong to components but never name one; where no row of a component has an
    id its rows are kept. Rows equal in id and text are kept or dropped together,
    and ``_row`` tells rows apart that are equal in id only.
    """
    share = round(threshold * 100)
    sigs = checkpointed(signatures(docs, words, k))
    classes = (
        sigs.filter(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.min(F.struct("doc_id", "_row")).alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.xxhash64("digest"))
    )
    classes = checkpointed(classes)

    # inverted lists of the retained values that at least two classes have
    postings = classes.select("node", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("value"))
    counts = postings.groupBy("value").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1")
    shared = postings.join(counts, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("all"))
    need = required(F.least("n", F.lit(k)), threshold, k)
    weight = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    prefixes = shared.withColumn("_more", F.size("all") - need + 1).filter("_more > 0").select("node", "n", weight.alias("weight"), F.slice("all", F.lit(1), F.col("_more")).alias("rare"))
    prefixes = checkpointed(prefixes.withColumn("rare", F.col("rare.value")))
    close = lambda a, b: (100 * F.col(a) >= share * F.col(b)) & (100 * F.col(b) >= share * F.col(a))
    lists = prefixes.select("node", "n", "weight", F.explode("rare").alias("value"))
    label = None
    for turn in range(3):
        best = F.max(F.struct("weight", "node", "n", *["root"] * bool(turn))).alias("c")
        if turn:
            # only lists whose classes are in several components still matter; a long one is dealt in blocks
            named = prefixes.join(label, prefixes["node"] == label["_node"], "left").select("node", "n", "weight", F.explode("rare").alias("value"), F.coalesce("_root", "node").alias("root"))
            several = named.groupBy("value").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("blocks"), best)
            several = several.filter("_lo <> _hi").select("value", *(["blocks"] if turn > 1 else [F.col("c.root").alias("first")]))
            # what is joined with a list's rows is written first: such joins are split where a value is hot
            lists = checkpointed(named.join(checkpointed(several), "value"))
            if lists.isEmpty():
                break
        if turn < 2:
            # every class meets the most typical one; in the second turn, the most typical of those outside the first one's component
            heads = checkpointed((lists.filter("root <> first") if turn else lists).groupBy("value").agg(best))
            met = lists.join(heads.select("value", F.col("c.node").alias("b"), F.col("c.n").alias("nb")), "value").withColumnsRenamed({"node": "a", "n": "na"})
            pairs = met.filter((F.col("a") != F.col("b")) & close("na", "nb"))
        else:
            nodes = lists.select("node").distinct()
            # written, so that the two sides of a join read the same rows
            wide = checkpointed(parities(marks(docs, checkpointed(keys_of(classes, nodes)), words)))

            def alike(a, b):
                same = most_shared(a, b)
                # sets that are known whole are measured as such, others by their wider sketches
                whole = (a("n") <= WIDE) & (b("n") <= WIDE)
                likely = F.when(whole, 100 * same >= share * (a("n") + b("n") - same)).otherwise(same >= required(F.least(a("n"), b("n"), F.lit(WIDE)), threshold, WIDE))
                # a pair is made once, in the list of the first value that both prefixes have
                once = F.get(F.array_intersect(a("rare"), b("rare")), F.lit(0)) == a("value")
                return (a("root") != b("root")) & (100 * a("n") >= share * b("n")) & (100 * b("n") >= share * a("n")) & likely & once

            side = lists.select("value", "root", "node", "n", "blocks").join(wide, "node")
            pairs = met_in_cells(side.join(prefixes.select("node", "rare"), "node"), alike)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = verified(docs, classes, checkpointed(likely_pairs(pairs, classes, threshold, k)), words, share)
        # what is linked already comes in as the stars that it makes
        roots = components(fresh if label is None else fresh.unionByName(label.select(F.col("_node").alias("a"), F.col("_root").alias("b"))))
        label = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))

    tied = classes.join(label, classes["node"] == label["_node"], "left").select("digest", "least", F.coalesce("_root", "node").alias("root"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tied.join(ids, "root").select(F.col("digest").alias("_digest"), "component_id")
    out = sigs.join(named, sigs["digest"] == named["_digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keys_of(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents (_id, _key, node, digest) that stand for the classes named by ``nodes``."""
    return classes.join(nodes, "node").select(F.col("rep.doc_id").alias("_id"), F.col("rep._row").alias("_key"), "node", "digest")


def likely_pairs(pairs: DataFrame, classes: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) of nodes whose joint sketch is promising."""
    sketches = classes.select(F.col("node").alias("_n"), "n", "sketch")
    both = pairs.join(sketches.withColumnsRenamed({"_n": "a", "sketch": "sa", "n": "na"}), "a").join(sketches.withColumnsRenamed({"_n": "b", "sketch": "sb", "n": "nb"}), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    likely = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) >= required(F.least("na", "nb", F.lit(k)), threshold, k)
    return both.filter(likely).select("a", "b")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, share: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = full_sets(docs, checkpointed(keys_of(classes, nodes)), words).dropDuplicates(["node", "digest"])
    sets = checkpointed(sets)
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb"))
    same = F.size(F.array_intersect("xa", "xb")).alias("same")
    held = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", same)
    return held.filter(100 * F.col("same") >= share * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")
