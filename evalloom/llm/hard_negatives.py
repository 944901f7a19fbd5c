"""Hard negatives by a vector-approximation file.

Vectors of integers are packed into blocks: each dimension is quantised into
cells of about equal population (one byte a dimension), and beside these
approximations stand the vectors themselves. A scan looks an anchor's products
with the cells' ends up in one table a dimension; their sums bound a row's
score from both sides. Only rows whose bounds may still enter what an anchor
has so far are scored, by their integers.

Two scans follow each other: of an anchor's own label for its positives, and of
the other labels for what lies in the positives' windows. Anchors come in
groups of bounded size, which are what is broadcast; the file is read once a
scan and group, and each task returns a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.llm.common import drop_shuffles, python_ready
from evalloom.llm.token_files import shared_path

#: Cells of a dimension at most, rows of a block, and rows and anchors whose bounds are held at once.
CELLS, BLOCK_ROWS, CHUNK_ROWS, CHUNK_ANCHORS = 64, 4096, 1024, 256
#: Components of the anchors of one group, about; the group's anchors are collected and broadcast.
GROUP_VALUES = 1 << 19
#: Pairs that are scored at once.
SCORED = 1 << 15
#: Below every score; above every id, and what a null id stands for.
LEAST, LAST = -(1 << 62), (1 << 63) - 1
_PACKED = "block long, dims int, n_anchors int, ids binary, labels binary, codes binary, vectors binary, a_spots binary, a_ids binary, a_labels binary, a_vectors binary"


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that have a label and a vector of finite components: floor(scale * component) as longs."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("v"))


def cell_edges(rows: DataFrame, cells: int = CELLS) -> dict[int, list[np.ndarray]]:
    """For each length of vector its dimensions' ends of cells: the least value, the first values of further cells, and one above the greatest."""
    marks = [k / cells for k in range(1, cells)]
    each = rows.select(F.size("v").alias("dims"), F.posexplode("v").alias("at", "x"))
    found = each.groupBy("dims", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", marks, 1000).alias("marks")).orderBy("dims", "at").collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in found:
        if max(abs(r["low"]), abs(r["high"])) ** 2 * r["dims"] >= 1 << 61:
            raise ValueError("scores of these vectors do not fit a long")
        out.setdefault(r["dims"], []).append(np.array(sorted({r["low"], *r["marks"], r["high"] + 1}), np.int64))
    return out


def write(rows: DataFrame, path: str, edges: dict[int, list[np.ndarray]]) -> None:
    """The approximation file of (vec_id, label, v, anchor): each task packs the rows it reads, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple]] = {}
        made, first = 0, TaskContext.get().partitionId() << 24

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, values, anchor = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            order = np.argsort(labels, kind="stable")
            ids, labels, values, anchor = ids[order], labels[order], values[order], anchor[order]
            codes = np.array([np.searchsorted(edges[dims][d], values[:, d], "right") - 1 for d in range(dims)], np.uint8)
            spots = np.flatnonzero(anchor)
            row = [first + made, dims, len(spots), ids, labels, codes, values, spots, ids[spots], labels[spots], values[spots]]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, int) else np.ascontiguousarray(x).tobytes()], t) for x, t in zip(row, kinds, strict=True)], names=names)

        names = [x.split()[0] for x in _PACKED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 8
        for batch in batches:
            lists = batch.column("v")
            sizes = np.asarray(lists.value_lengths())
            flat, ends = np.asarray(lists.flatten()).astype(np.int64), np.cumsum(sizes)
            columns = [batch.column("vec_id").fill_null(LAST).to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False), batch.column("anchor").to_numpy(zero_copy_only=False)]
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                values = flat[(ends[own] - dims)[:, None] + np.arange(dims)]
                for k in range(0, len(own), BLOCK_ROWS):
                    part = own[k : k + BLOCK_ROWS]
                    if sum(len(x[0]) for x in held.get(dims, [])) + len(part) > BLOCK_ROWS:
                        yield block(dims)
                    held.setdefault(dims, []).append((columns[0][part], columns[1][part], values[k : k + BLOCK_ROWS], columns[2][part]))
        for dims in sorted(held):
            yield block(dims)

    rows.select("vec_id", "label", "v", "anchor").mapInArrow(run, _PACKED).write.parquet(path)


class _Group:
    """Anchors of one length, by label, with the tables' parts that depend on the dimension alone."""

    def __init__(self, dims: int, edges: list[np.ndarray], packed: list[tuple[int, bytes, bytes, bytes, bytes]]):
        parts = [(np.int64(block << 13) + np.frombuffer(spots, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(v, np.int64).reshape(-1, dims)) for block, spots, ids, labels, v in packed]
        key, ids, labels, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, labels))
        self.dims, self.key, self.ids, self.labels, self.values = dims, key[order], ids[order], labels[order], values[order]
        widest = max((int(np.abs(e).max()) for e in edges), default=0)
        self.kind = np.int32 if dims * widest * max(1, int(np.abs(values).max(initial=0))) < 1 << 30 else np.int64
        self.low = [e[:-1].astype(self.kind) for e in edges]
        self.high = [(e[1:] - 1).astype(self.kind) for e in edges]

    def tables(self, some: slice) -> list[np.ndarray]:
        """For each dimension (cell, 2 x anchor): the greatest product of the cell with each anchor, then the least."""
        q = self.values[some].astype(self.kind)
        out = []
        for d in range(self.dims):
            a, b = self.low[d][:, None] * q[:, d], self.high[d][:, None] * q[:, d]
            out.append(np.concatenate([np.maximum(a, b), np.minimum(a, b)], axis=1))
        return out

    def bounds(self, tables: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and the least score of each (row, anchor) by table lookup."""
        n = tables[0].shape[1] if tables else 0
        total, one = np.zeros((codes.shape[1], n), self.kind), np.empty((codes.shape[1], n), self.kind)
        for d, table in enumerate(tables):
            np.take(table, codes[d], axis=0, out=one, mode="clip")
            total += one
        return total[:, : n // 2], total[:, n // 2 :]

    def scores(self, values: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for k in range(0, len(row), SCORED):
            out[k : k + SCORED] = np.einsum("nd,nd->n", values[row[k : k + SCORED]], self.values[anchor[k : k + SCORED]])
        return out


def _merge(best: np.ndarray, ids: np.ndarray, of: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
    """Keep the first rows of each slot ``of``: higher scores, then smaller ids."""
    if not len(of):
        return
    size = best.shape[1]
    slots = np.unique(of)
    slot = np.concatenate([np.repeat(slots, size), of])
    s, i = np.concatenate([best[slots].ravel(), score]), np.concatenate([ids[slots].ravel(), vec_id])
    order = np.lexsort((i, -s, slot))
    slot, s, i = slot[order], s[order], i[order]
    rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
    keep = rank < size
    best[slot[keep], rank[keep]], ids[slot[keep], rank[keep]] = s[keep], i[keep]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            block, ids, labels, codes, values = (batch.column(c)[k] for c in ("block", "ids", "labels", "codes", "vectors"))
            ids, labels = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int64)
            yield block.as_py(), ids, labels, np.frombuffer(codes.as_buffer(), np.uint8).reshape(dims, len(ids)), np.frombuffer(values.as_buffer(), np.int64).reshape(len(ids), dims)


def _positives(group, count: int):
    """The first ``count`` rows of each anchor's own label, itself left out."""

    def run(batches):
        g: _Group = group.value
        best, kept = np.full((len(g.key), count), LEAST), np.full((len(g.key), count), LAST)
        for block, ids, labels, codes, values in _blocks(batches, g.dims):
            for label in np.intersect1d(labels, g.labels):
                (r0, r1), (a0, a1) = (np.searchsorted(x, [label, label + 1]).tolist() for x in (labels, g.labels))
                for a in range(a0, a1, CHUNK_ANCHORS):
                    some = slice(a, min(a1, a + CHUNK_ANCHORS))
                    tables = g.tables(some)
                    for r in range(r0, r1, CHUNK_ROWS):
                        rows = slice(r, min(r1, r + CHUNK_ROWS))
                        high, low = g.bounds(tables, codes[:, rows])
                        own = (g.key[some] >> 13 == block) & (g.key[some] % (1 << 13) >= rows.start) & (g.key[some] % (1 << 13) < rows.stop)
                        at = np.flatnonzero(own)
                        spot = g.key[some][at] % (1 << 13) - rows.start
                        least = best[some, -1]
                        if low.shape[0] > count:
                            # the anchor itself may be among the first, so one more lower bound is asked for
                            least = np.maximum(least, np.partition(low, -count - 1, axis=0)[-count - 1])
                        maybe = high >= least
                        maybe[spot, at] = False
                        row, anchor = np.nonzero(maybe)
                        _merge(best, kept, anchor + a, g.scores(values, row + rows.start, anchor + a), ids[row + rows.start])
        at, rank = np.nonzero(best > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.key[at], best[at, rank], kept[at, rank])], names=["key", "score", "vec_id"])

    return run


def _negatives(group, windows, count: int):
    """The first ``count`` rows of other labels in each of an anchor's windows."""

    def run(batches):
        g: _Group = group.value
        lower, upper = windows.value
        n, wide = lower.shape
        best, kept = np.full((n * wide, count), LEAST), np.full((n * wide, count), LAST)
        for _, ids, labels, codes, values in _blocks(batches, g.dims):
            for a in range(0, n, CHUNK_ANCHORS):
                some = slice(a, min(n, a + CHUNK_ANCHORS))
                tables = g.tables(some)
                for r in range(0, len(ids), CHUNK_ROWS):
                    rows = slice(r, r + CHUNK_ROWS)
                    high, low = g.bounds(tables, codes[:, rows])
                    least = np.maximum(lower[some], best[:, -1].reshape(n, wide)[some])
                    row, anchor = np.nonzero((high >= least.min(axis=1)) & (labels[rows, None] != g.labels[some]))
                    enters = ((high[row, anchor][:, None] >= least[anchor]) & (low[row, anchor][:, None] <= upper[some][anchor])).any(axis=1)
                    row, anchor = row[enters] + r, anchor[enters] + a
                    score = g.scores(values, row, anchor)
                    pair, window = np.nonzero((score[:, None] >= lower[anchor]) & (score[:, None] <= upper[anchor]))
                    _merge(best, kept, anchor[pair] * wide + window, score[pair], ids[row[pair]])
        at, rank = np.nonzero(best > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.key[at // wide], (at % wide).astype(np.int32), best[at, rank], kept[at, rank])], names=["key", "window", "score", "vec_id"])

    return run


def _first(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id long, label long, v array<long>).

    ``anchors`` says which rows are anchors. An anchor's positives are its first
    ``positives`` other rows of the same label by inner product, ties by smaller
    id; for each, the first ``negatives`` rows of other labels follow whose
    scores lie between ``low`` and ``high`` percent of the positive's. Rows are
    told apart by their place and not by id, so a repeated row is another row,
    and a repeated anchor returns its rows again. A null id is no anchor, comes
    last among ties and is returned as null (the greatest long stands for it).
    Vectors of different lengths have no score with each other. An anchor
    without a positive, a positive without a row in its window and an empty
    table give no rows. Scores have to fit a long, else the call fails.
    """
    spark: SparkSession = rows.sparkSession
    python_ready(spark, 1024)
    drop_shuffles(spark)
    edges = cell_edges(rows)
    path, out = shared_path(spark, "approximations"), shared_path(spark, "hard-negatives")
    write(rows.withColumn("anchor", F.coalesce(anchors, F.lit(False))), path, edges)
    blocks = spark.read.parquet(path)
    parts = []
    for dims, own in sorted(edges.items()):
        file = blocks.filter(F.col("dims") == dims)
        total = file.agg(F.coalesce(F.sum("n_anchors"), F.lit(0))).first()[0]
        groups = -(-total * dims // GROUP_VALUES)
        for k in range(groups):
            mine = file.filter((F.col("n_anchors") > 0) & (F.pmod(F.xxhash64("block"), F.lit(groups)) == k))
            packed = mine.select("block", "a_spots", "a_ids", "a_labels", "a_vectors").collect()
            if not packed:
                continue
            g = _Group(dims, own, [tuple(r) for r in packed])
            group = spark.sparkContext.broadcast(g)
            scan = file.select("block", "ids", "labels", "codes", "vectors")
            found = _first(scan.mapInArrow(_positives(group, positives), "key long, score long, vec_id long"), positives, "key").collect()
            place = {key: i for i, key in enumerate(g.key.tolist())}
            lower, upper = np.full((len(place), positives), -LEAST), np.full((len(place), positives), LEAST)
            for r in found:
                i, p = place[r["key"]], r["rank"] - 1
                lower[i, p], upper[i, p] = -(-low * r["score"] // 100), high * r["score"] // 100
            windows = spark.sparkContext.broadcast((lower, upper))
            close = _first(scan.mapInArrow(_negatives(group, windows, negatives), "key long, window int, score long, vec_id long"), negatives, "key", "window")
            named = [(r["key"], r["rank"] - 1, int(g.ids[place[r["key"]]]), r["vec_id"], r["score"]) for r in found]
            if named:
                # as many rows as a group's anchors have positives
                table = spark.createDataFrame(named, "key long, window int, anchor_id long, positive_id long, positive_score long")
                result = close.join(F.broadcast(table), ["key", "window"])
                ids = [F.nullif(F.col(c), F.lit(LAST)).alias(to) for c, to in (("positive_id", "positive_id"), ("vec_id", "negative_id"))]
                result.select("anchor_id", ids[0], "rank", ids[1], "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/part={len(parts)}")
                parts.append(len(parts))
            windows.destroy()
            group.destroy()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.parquet(out).drop("part")
