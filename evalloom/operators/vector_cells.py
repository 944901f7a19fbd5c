"""Exact cosine lists over vectors in cells, of which most are never scored.

Vectors are scaled to length one, so cosine is 1 - d^2 / 2 of their distance d.
K-means cells are fitted on a bounded sample; every vector goes to its nearest
centre, and the vectors of a cell are packed into blocks by their distance from
it. The triangle inequality bounds a query's distance to a block by its
distance to the centre and the block's nearest and farthest member, so a block
that cannot reach the list so far is skipped unread by the arithmetic, and
lists stay exact. A search first scores the cells next to each query, which
gives it a k-th score, and then what may still be above that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.retrieval import BLOCK_QUERIES, LIST_K, dot, ranked
from evalloom.sources.session import python_ready, shared_place, shuffle_partitions

#: Vectors that the cells are fitted on at most, rounds of fitting, cells at most.
SAMPLE, ROUNDS, CELLS = 20_000, 8, 1024
#: Vectors of a block at most, and cells next to a query that are scored first.
BLOCK, PROBE = 512, 4
#: What rounding may add to a bound.
SLACK = 1e-9


def fitted(rows: DataFrame, key: str, cells: int | None = None) -> np.ndarray:
    """Centres (cell, dimension) by k-means over the ``SAMPLE`` vectors whose keys' hashes are least; about the root of their number many."""
    found = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("_v").toArrow().column("_v").combine_chunks()
    if not len(found):
        return np.zeros((0, 0))
    sizes = np.asarray(found.value_lengths())
    found = found.filter(pa.array(sizes == sizes[0]))
    sample = np.asarray(found.flatten()).reshape(len(found), -1)
    random = np.random.default_rng(0)
    count = min(len(sample), cells or max(1, min(CELLS, int(len(sample) ** 0.5))))
    centres = sample[random.choice(len(sample), count, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], centres)
    return centres


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * v @ centres.T, axis=1)


def write(vectors: DataFrame, path: str, key: str, vector: str, keep: tuple[str, ...] = (), cells: int | None = None) -> np.ndarray:
    """Write the cells' blocks and give the centres.

    Vectors that are null, have a null, no length or no key, or another number
    of dimensions than the sample's first take no part. Rows are range-partitioned
    by cell, distance and key, so that a cell with many members lies in several
    tasks; a repeated key is another vector.
    """
    spark = vectors.sparkSession
    python_ready(spark, 2048)
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *keep, F.col(vector).cast("array<double>").alias("_x"), norm.alias("_n")).filter((F.col("_n") > 0) & (F.col("_n") < float("inf")))
    rows = rows.select("_key", *keep, F.transform("_x", lambda x: x / F.col("_n")).alias("_v"))
    centres = fitted(rows, "_key", cells)
    dims = centres.shape[1]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("_v").flatten()).reshape(batch.num_rows, dims)
            cell = _nearest(v, centres)
            far = np.sqrt(((v - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "_cell", "_far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column("_cell"))
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            for first, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True):
                for k in range(first, stop, BLOCK):
                    part = batch.slice(k, min(stop, k + BLOCK) - k)
                    far = np.asarray(part.column("_far"))
                    v = np.asarray(part.column("_v").flatten())
                    kept = pa.StructArray.from_arrays([part.column(c) for c in ("_key", *keep)], names=["key", *keep])
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[k])], pa.int32()), pa.array([far.min()]), pa.array([far.max()]), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), kept), pa.array([v.tobytes()], pa.binary())], names=["cell", "near", "far", "members", "vectors"])

    placed = rows.filter(F.size("_v") == dims).mapInArrow(place, ", ".join([*(f"{c} {kind[c]}" for c in ("_key", *keep, "_v")), "_cell int, _far double"]))
    dealt = placed.repartitionByRange(shuffle_partitions(spark), "_cell", "_far", "_key").sortWithinPartitions("_cell", "_far", "_key")
    members = ", ".join([f"key: {kind['_key']}", *(f"{c}: {kind[c]}" for c in keep)])
    dealt.mapInArrow(pack, f"cell int, near double, far double, members array<struct<{members}>>, vectors binary").write.parquet(path)
    return centres


def _scan(shared, k: int, counts: bool):
    """Score blocks against the queries whose list they may enter; ``counts``: how many pairs there are, and how many are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, centres, least, probed, first = shared.value
        far = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * q @ centres.T))
        for batch in batches:
            for b in range(batch.num_rows):
                cell, near, wide = (batch.column(c)[b].as_py() for c in ("cell", "near", "far"))
                keys = np.asarray(batch.column("keys")[b].values)
                ok = np.asarray(batch.column("ok")[b].values, bool)
                v = np.frombuffer(batch.column("vectors")[b].as_buffer()).reshape(len(keys), -1)
                d = far[:, cell]
                gap = np.maximum(0, np.maximum(d - wide, near - d) - SLACK)
                asked = np.flatnonzero(probed[:, cell] if first else ~probed[:, cell] & (1 - gap**2 / 2 + SLACK >= least))
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([len(keys) * len(q) if first else 0], pa.int64()), pa.array([len(keys) * len(asked)], pa.int64())], names=["pairs", "scored"])
                    continue
                v, keys = v[ok], keys[ok]
                if not len(asked) or not len(keys):
                    continue
                row, of = np.nonzero(v @ q[asked].T >= least[asked] - SLACK)
                # summed up row by row, so that equal vectors have equal scores
                score = np.einsum("nd,nd->n", v[row], q[asked[of]])
                order = np.lexsort((keys[row], -score.round(12), of))
                row, of, score = row[order], of[order], score[order]
                best = np.arange(len(of)) - np.searchsorted(of, of) < k
                yield pa.RecordBatch.from_arrays([pa.array(asked[of[best]]), pa.array(keys[row[best]]), pa.array(score[best])], names=["_q", "_key", "score"])

    return run


def search(spark: SparkSession, path: str, centres: np.ndarray, queries: DataFrame, query: str, query_vector: str, key: str, k: int = LIST_K, allowed: Callable[[Column], Column] | None = None, counts: bool = False) -> DataFrame:
    """Cosine top k of every query vector over a written file: (query, key, score, rank).

    ``allowed`` gives a condition on a member (its key and kept columns); it
    stands inside the scan, before a list is cut. Scores are compared to twelve
    digits, ties go to the smaller key. Queries come in blocks of some
    ``BLOCK_QUERIES``, which are collected and broadcast with their lists' last
    scores. Query vectors without a length or of other dimensions have no list.
    With ``counts`` the result is how many pairs there are and were scored.
    """
    python_ready(spark, 16)
    blocks = spark.read.parquet(path)
    kind, key_kind = queries.schema[query].dataType.simpleString(), blocks.schema["members"].dataType.elementType["key"].dataType.simpleString()
    ok = F.transform("members", (lambda m: F.coalesce(allowed(m), F.lit(False))) if allowed else (lambda m: F.lit(True)))
    scan = blocks.select("cell", "near", "far", F.col("members.key").alias("keys"), ok.alias("ok"), "vectors")
    norm = F.sqrt(dot(F.col(query_vector), F.col(query_vector)))
    usable = queries.select(query, F.col(query_vector).cast("array<double>").alias("_x"), norm.alias("_n")).filter((F.col("_n") > 0) & (F.col("_n") < float("inf")) & (F.size("_x") == centres.shape[1]))
    usable = usable.select(query, F.transform("_x", lambda x: x / F.col("_n")).alias("_v"))
    groups = -(-usable.count() // BLOCK_QUERIES) if len(centres) else 0
    out: DataFrame | None = None
    for g in range(groups):
        rows = (usable.filter(F.pmod(F.xxhash64(query), F.lit(groups)) == g) if groups > 1 else usable).collect()
        if not rows:
            continue
        q = np.array([r["_v"] for r in rows], float)
        order = np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1)[:, : min(PROBE, len(centres))]
        probed = np.zeros((len(q), len(centres)), bool)
        np.put_along_axis(probed, order, True, axis=1)
        least = np.full(len(q), -2.0)
        place = shared_place(spark)
        parts = []
        for first in (True, False):
            shared = spark.sparkContext.broadcast((q, centres, least, probed, first))
            if counts and not first:
                parts.append(scan.mapInArrow(_scan(shared, k, True), "pairs long, scored long"))
                continue
            found = ranked(scan.mapInArrow(_scan(shared, k, False), f"_q long, _key {key_kind}, score double"), "_q", F.desc(F.round("score", 12)), "_key", k)
            if first:
                found.write.parquet(place)
                found = spark.read.parquet(place)
                least = least.copy()
                for r in found.groupBy("_q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).collect():  # a row for each query of the block
                    least[r["_q"]] = r["s"] - SLACK
                if counts:
                    parts.append(scan.mapInArrow(_scan(shared, k, True), "pairs long, scored long"))
                    continue
            parts.append(found.select("_q", "_key", "score"))
        both = parts[0].unionByName(parts[1])
        if not counts:
            names = spark.createDataFrame([(i, r[query]) for i, r in enumerate(rows)], f"_q long, {query} {kind}")
            both = both.join(F.broadcast(names), "_q").select(query, F.col("_key").alias(key), "score")
        out = both if out is None else out.unionByName(both)
    if counts:
        return (out if out is not None else spark.createDataFrame([], "pairs long, scored long")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    if out is None:
        return spark.createDataFrame([], f"{query} {kind}, {key} {key_kind}, score double, rank int")
    return ranked(out, query, F.desc(F.round("score", 12)), key, k)


def cosine_lists(queries: DataFrame, vectors: DataFrame, query: str, query_vector: str, key: str, vector: str, k: int = LIST_K, keep: tuple[str, ...] = (), allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """:func:`write` and :func:`search` in one: exact lists over vectors that are not written yet."""
    path = shared_place(vectors.sparkSession)
    centres = write(vectors, path, key, vector, keep)
    return search(vectors.sparkSession, path, centres, queries, query, query_vector, key, k, allowed)
