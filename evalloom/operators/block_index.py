"""An inverted index in blocks, and exact BM25 lists by MaxScore over it.

Documents lie in buckets by the hash of their document's key, a bucket in
segments of bounded size. Within a segment documents are numbered by length, so
that those of a block are about as long; a term's postings are cut into blocks
of 128, whose numbers are delta-coded and, like the frequencies, bit-packed
with the fewest bits that the block needs. Beside each block stand its greatest
frequency and its least length: together they bound the block's largest score
whatever the average length is by then.

A search joins the index with the queries' terms and walks each segment by
itself. Terms come by falling bound; once those that are left cannot lift a new
document into the list, only blocks are unpacked that hold a document which is
still in the running. Lists are exact; only the rows of the segments' lists are
exchanged.

The index is a table of :mod:`evalloom.sources.snapshots`: replacing documents
rewrites their buckets and publishes all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from evalloom.functions.text import search_tokens
from evalloom.operators.retrieval import B, K1, LIST_K
from evalloom.sources import snapshots
from evalloom.sources.session import python_ready, shuffle_partitions

BLOCK = 128
#: Postings (terms of documents) of a segment, about, and documents at most.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1 << 21, 1 << 16
#: (query, term) rows of the queries that are broadcast at once, about.
QUERY_TERMS = 200_000
_BLOCK_COLUMNS = "term string, first int, last int, n int, d_bits int, t_bits int, max_tf int, min_length long, payload binary"


def document_rows(chunks: DataFrame, document: str, key: str, text: str, tokens=search_tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """(document, key, the columns to keep, terms, tfs): each text is cut into its tokens once; a null text has none."""
    python_ready(chunks.sparkSession)
    cut = chunks.select(F.col(document).alias("document"), F.col(key).alias("key"), *keep, tokens(F.col(text)).alias("terms"))
    return cut.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).withColumn("tfs", F.array_repeat(F.lit(1), F.size("terms")))


# --- packing


def _packed_bits(values: np.ndarray, bits: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Bytes in which value i takes ``bits[i]`` bits from bit ``starts[i]`` on."""
    out = np.zeros(total, np.uint8)
    for bit in range(int(bits.max(initial=0))):
        some = bits > bit
        out[starts[some] + bit] = (values[some] >> bit) & 1
    return np.packbits(out, bitorder="little")


def _unpacked_bits(bit: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values that take ``bits`` bits each from ``starts`` on, as :func:`_packed_bits` put them."""
    out = np.zeros(len(bits), np.int64)
    for k in range(int(bits.max(initial=0))):
        some = bits > k
        out[some] |= bit[starts[some] + k].astype(np.int64) << k
    return out


def unpack(data: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray, d_bits: np.ndarray, t_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and frequencies of blocks, one after the other; ``at``: where each one's bytes begin in ``data``, one after the other as well."""
    n, d_bits, t_bits, first = (x.astype(np.int64) for x in (n, d_bits, t_bits, first))
    sizes = -(-((n - 1) * d_bits + n * t_bits) // 8)
    own = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())) if len(at) else np.zeros(0, np.int64)
    bit = np.unpackbits(data[own], bitorder="little")
    start = 8 * (np.cumsum(sizes) - sizes)
    block, head = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    spot = np.arange(len(block)) - head[block]
    steps = np.zeros(len(block), np.int64)
    later = spot > 0
    steps[later] = 1 + _unpacked_bits(bit, d_bits[block[later]], start[block[later]] + (spot[later] - 1) * d_bits[block[later]])
    run = np.cumsum(steps)
    doc = first[block] + run - run[head][block] if len(block) else run
    return doc, 1 + _unpacked_bits(bit, t_bits[block], (start + (n - 1) * d_bits)[block] + spot * t_bits[block])


def _payloads(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value begins."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = pa.concat_arrays([whole.cast(pa.large_binary())])
    _, offsets, data = whole.buffers()
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole)]


def _segment(lengths: np.ndarray, doc: np.ndarray, code: np.ndarray, tf: np.ndarray) -> tuple:
    """Arrays of a segment's blocks from its postings: documents numbered by length already."""
    order = np.lexsort((doc, code))
    doc, code, tf = doc[order], code[order], tf[order]
    term_start = np.flatnonzero(np.diff(code, prepend=-1))
    place = np.arange(len(doc)) - np.repeat(term_start, np.diff(np.append(term_start, len(doc))))
    start = np.flatnonzero(place % BLOCK == 0)
    n = np.diff(np.append(start, len(doc)))
    block = np.repeat(np.arange(len(start)), n)
    head = np.zeros(len(doc), bool)
    head[start] = True
    step = np.where(head, 0, doc - np.concatenate([[0], doc[:-1]]) - 1)
    width = lambda x: np.ceil(np.log2(np.maximum.reduceat(x, start) + 1)).astype(np.int64)
    d_bits, t_bits = width(step), width(tf - 1)
    sizes = -(-((n - 1) * d_bits + n * t_bits) // 8)
    at = 8 * (np.cumsum(sizes) - sizes)
    spot = np.arange(len(doc)) - np.repeat(start, n)
    d_at = at[block] + (spot - 1) * d_bits[block]
    t_at = at[block] + (n - 1)[block] * d_bits[block] + spot * t_bits[block]
    values = np.concatenate([step[~head], tf - 1])
    data = _packed_bits(values, np.concatenate([d_bits[block][~head], t_bits[block]]), np.concatenate([d_at[~head], t_at]), 8 * int(sizes.sum()))
    ends = np.append(start[1:], len(doc)) - 1
    return code[start], doc[start], doc[ends], n, d_bits, t_bits, np.maximum.reduceat(tf, start), np.minimum.reduceat(lengths[doc], start), sizes, data


def _build(schema: pa.Schema, keep: list[str], segments: int):
    docs_type = schema.field("docs").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state = {"bucket": None, "segment": 0, "postings": 0, "docs": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            state["postings"] = state["docs"] = 0
            n_docs = rows.num_rows
            lists, counts = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
            of = np.repeat(np.arange(n_docs), np.asarray(lists.value_lengths()))
            flat = lists.flatten().dictionary_encode()
            tf = np.asarray(counts.flatten()).astype(np.int64)
            lengths = np.zeros(n_docs, np.int64)
            np.add.at(lengths, of, tf)
            order = np.argsort(lengths, kind="stable")
            number = np.empty(n_docs, np.int64)
            number[order] = np.arange(n_docs)
            segment = state["bucket"] * segments + state["segment"]
            state["segment"] += 1
            if state["segment"] > segments:
                raise ValueError("a bucket has too many segments; the table needs more buckets")
            columns = [rows.column(c).combine_chunks().take(pa.array(order)) for c in ("document", "key", *keep)]
            docs = pa.StructArray.from_arrays([pa.array(np.arange(n_docs), pa.int32()), *columns, pa.array(lengths[order])], fields=list(docs_type.value_type))
            one = {"_bucket": [state["bucket"]], "segment": [segment], "docs": pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), docs)}
            yield pa.RecordBatch.from_arrays([pa.array(one[f.name], f.type) if f.name != "docs" and f.name in one else one["docs"].cast(f.type) if f.name == "docs" else pa.nulls(1, f.type) for f in schema], schema=schema)
            if not len(of):
                return
            # postings in the order of the terms' spelling, so that a search for terms skips row groups
            words = flat.dictionary
            rank = np.empty(len(words), np.int64)
            by_word = pa.compute.sort_indices(words)
            rank[np.asarray(by_word)] = np.arange(len(words))
            code, doc = rank[np.asarray(flat.indices)], number[of]
            each, back = np.unique(code * n_docs + doc, return_inverse=True)
            total = np.zeros(len(each), np.int64)
            np.add.at(total, back, tf)
            code, first, last, n, d_bits, t_bits, max_tf, min_length, sizes, data = _segment(lengths[order], each % n_docs, each // n_docs, total)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = {
                "_bucket": np.full(len(n), state["bucket"]), "segment": np.full(len(n), segment), "term": words.take(by_word).take(pa.array(code)), "first": first, "last": last, "n": n, "d_bits": d_bits, "t_bits": t_bits,
                "max_tf": max_tf, "min_length": min_length, "payload": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]),
            }
            arrays = [pa.nulls(len(n), f.type) if f.name == "docs" else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name]).cast(f.type) for f in schema]
            batch = pa.RecordBatch.from_arrays(arrays, schema=schema)
            for k in range(0, batch.num_rows, 50_000):
                yield batch.slice(k, 50_000)

        for batch in batches:
            bucket, sizes = np.asarray(batch.column("_bucket")), np.asarray(batch.column("terms").value_lengths())
            k = 0
            while k < batch.num_rows:
                if bucket[k] != state["bucket"]:
                    if held:
                        yield from flush()
                    state.update(bucket=int(bucket[k]), segment=0)
                stop = int(np.searchsorted(bucket, bucket[k], "right"))
                room = np.searchsorted(np.cumsum(sizes[k:stop]), max(1, SEGMENT_POSTINGS - state["postings"]), "right")
                m = min(stop, k + max(1, int(room)), k + SEGMENT_DOCS - state["docs"])
                held.append(batch.slice(k, m - k))
                state["postings"] += int(sizes[k:m].sum())
                state["docs"] += m - k
                if state["postings"] >= SEGMENT_POSTINGS or state["docs"] >= SEGMENT_DOCS or (m < stop):
                    yield from flush()
                k = m
        if held:
            yield from flush()

    return run


def dealt(rows: DataFrame, document: str, buckets: int) -> DataFrame:
    """Rows with _bucket, those of a bucket in one partition; the number of partitions is stated, so that small tables keep it."""
    return rows.withColumn("_bucket", snapshots.bucket_of([document], buckets)).repartition(min(buckets, shuffle_partitions(rows.sparkSession)), "_bucket")


def blocks_of(rows: DataFrame) -> DataFrame:
    """The index of :func:`dealt` document rows: for each segment one row with ``docs``, and one for each block of a term; _bucket says where they go.

    Every task packs the segments of its buckets one after the other, so it
    holds one segment.
    """
    spark = rows.sparkSession
    python_ready(spark, 1000)
    keep = [c for c in rows.columns if c not in ("document", "key", "terms", "tfs", "_bucket")]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    docs = ", ".join(["number: int", *[f"{c}: {kind[c]}" for c in ("document", "key", *keep)], "length: long"])
    schema = StructType.fromDDL(f"_bucket int, segment long, docs array<struct<{docs}>>, {_BLOCK_COLUMNS}")
    return rows.sortWithinPartitions("_bucket", "key").mapInArrow(_build(to_arrow_schema(schema), keep, 1 << 20), schema)


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, number, document, key, kept columns, length), a row for each document."""
    return index.filter(F.col("term").isNull()).select("segment", F.inline("docs"))


def postings_of(index: DataFrame) -> DataFrame:
    """(segment, term, number, tf): the index unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n, d_bits, t_bits = (np.asarray(batch.column(c)) for c in ("first", "n", "d_bits", "t_bits"))
            doc, tf = unpack(*_payloads(batch.column("payload")), first, n, d_bits, t_bits)
            of = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch.column("segment").take(of), batch.column("term").take(of), pa.array(doc.astype(np.int32)), pa.array(tf.astype(np.int32))], names=["segment", "term", "number", "tf"])

    python_ready(index.sparkSession)
    blocks = index.filter(F.col("term").isNotNull()).select("segment", "term", "first", "n", "d_bits", "t_bits", "payload")
    return blocks.mapInArrow(run, "segment long, term string, number int, tf int")


def _by_segment(index: DataFrame, docs: DataFrame, run, schema: StructType) -> DataFrame:
    """``run`` (blocks, documents) for each segment by itself: packed blocks are exchanged, postings are not."""
    python_ready(index.sparkSession)
    blocks = index.filter(F.col("term").isNotNull()).select("segment", "term", "first", "n", "d_bits", "t_bits", "payload")
    return blocks.groupBy("segment").cogroup(docs.groupBy("_segment")).applyInArrow(run, schema)


def _unpacked(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, frequency and block of every posting."""
    if not blocks.num_rows:
        return (np.zeros(0, np.int64),) * 3
    first, n, d_bits, t_bits = (np.asarray(blocks.column(c).combine_chunks()) for c in ("first", "n", "d_bits", "t_bits"))
    doc, tf = unpack(*_payloads(blocks.column("payload")), first, n, d_bits, t_bits)
    return doc, tf, np.repeat(np.arange(blocks.num_rows), n)


def term_totals(index: DataFrame) -> DataFrame:
    """(term, df, tf, longest): how many documents have a term, how often it stands in all, and the greatest length of those documents."""
    schema = StructType.fromDDL("term string, df long, tf long, longest long")

    def run(keys, blocks: pa.Table, docs: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return to_arrow_schema(schema).empty_table()
        doc, tf, of = _unpacked(blocks)
        numbers = np.asarray(docs.column("number").combine_chunks())
        length = np.zeros(int(numbers.max()) + 1, np.int64)
        length[numbers] = np.asarray(docs.column("length").combine_chunks())
        start = np.searchsorted(of, np.arange(blocks.num_rows))
        return pa.table({"term": blocks.column("term").cast(pa.string()), "df": np.diff(start, append=len(of)), "tf": np.add.reduceat(tf, start), "longest": np.maximum.reduceat(length[doc], start)})

    found = _by_segment(index, documents_of(index).select(F.col("segment").alias("_segment"), "number", "length"), run, schema)
    return found.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "tf")], F.max("longest").alias("longest"))


def _rows_of(index: DataFrame, keep: list[str], gone: DataFrame) -> DataFrame:
    """The index as document rows again, without the documents (_gone) that go: those are left out before postings are unpacked."""
    docs = documents_of(index)
    docs = docs.join(gone, docs["document"].eqNullSafe(gone["_gone"]), "left_anti").select(F.col("segment").alias("_segment"), "number", "document", "key", *keep)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = StructType.fromDDL(", ".join([*(f"{c} {kind[c]}" for c in ("document", "key", *keep)), "terms array<string>, tfs array<int>"]))

    def run(keys, blocks: pa.Table, docs: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return to_arrow_schema(schema).empty_table()
        numbers = np.asarray(docs.column("number").combine_chunks())
        doc, tf, of = _unpacked(blocks)
        place = np.full(max(int(numbers.max()), int(doc.max(initial=0))) + 1, -1)
        place[numbers] = np.arange(len(numbers))
        row = place[doc]
        order = np.flatnonzero(row >= 0)
        order = order[np.argsort(row[order], kind="stable")]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[order], minlength=len(numbers)))]).astype(np.int32))
        terms = blocks.column("term").cast(pa.string()).combine_chunks().take(pa.array(of[order])) if len(order) else pa.array([], pa.string())
        lists = [pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf[order].astype(np.int32)))]
        return pa.table([*(docs.column(c) for c in ("document", "key", *keep)), *lists], names=["document", "key", *keep, "terms", "tfs"])

    return _by_segment(index, docs, run, schema)


def write(chunks: DataFrame, path: str, document: str, key: str, text: str, tokens=search_tokens, keep: tuple[str, ...] = (), asked: DataFrame | None = None, buckets: int = snapshots.BUCKETS) -> int:
    """Index ``chunks`` in place of all chunks of the documents that they (or ``asked``) name; gives the new version.

    Postings, documents and with them all statistics change at once. A document
    of which no chunk is given goes. A chunk without tokens counts as one of
    length 0. Keys are longs; a repeated key is another chunk.
    """
    spark: SparkSession = chunks.sparkSession
    base = snapshots.manifest(spark, path)
    buckets = base["buckets"] if base else buckets
    if base is None:  # texts are dealt before they are cut: they are smaller than their tokens
        rows = document_rows(dealt(chunks.select(F.col(document).alias("document"), F.col(key).alias("key"), *keep, F.col(text).alias("_text")), "document", buckets), "document", "key", "_text", tokens, (*keep, "_bucket"))
        return snapshots.publish(spark, path, None, blocks_of(rows), None, ["document"], buckets, ready=True)
    rows = document_rows(chunks, document, key, text, tokens, keep)
    gone = (chunks if asked is None else asked).select(F.col(document).alias("_gone")).distinct()
    affected = snapshots.asked_buckets(gone, ["_gone"], buckets)
    stay = _rows_of(snapshots.read(spark, path, base["version"], affected), list(keep), gone)
    return snapshots.publish(spark, path, base, blocks_of(dealt(rows.unionByName(stay), "document", buckets)), affected, ["document"], buckets, ready=True)


def stats(index: DataFrame) -> DataFrame:
    """One row: n chunks and their average length, 0 when there are none."""
    return documents_of(index).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))


# --- search


class _Segment:
    """A segment's blocks of the wanted terms, by term; each block is unpacked once at most."""

    def __init__(self, blocks: pa.Table, docs: pa.Table, n: int, average: float):
        blocks = blocks.sort_by([("term", "ascending"), ("first", "ascending")])
        take = lambda t, c: np.asarray(t.column(c).combine_chunks())
        self.first, self.last, self.n, self.d_bits, self.t_bits = (take(blocks, c) for c in ("first", "last", "n", "d_bits", "t_bits"))
        self.data, self.begins = _payloads(blocks.column("payload"))
        df = take(blocks, "df").astype(float)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
        self.bound = self.idf * impact(take(blocks, "max_tf").astype(float), take(blocks, "min_length").astype(float))
        terms = blocks.column("term").to_pylist()
        self.at: dict[str, tuple[int, int]] = {}
        for k, t in enumerate(terms):
            self.at[t] = (self.at.get(t, (k, k))[0], k + 1)
        order = np.argsort(take(docs, "number"))
        self.key, self.ok = take(docs, "key")[order], take(docs, "_ok").astype(bool)[order]
        self.factor = K1 * (1 - B + B * take(docs, "length")[order].astype(float) / average)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.met = self.read = 0

    def scores(self, spots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and their parts of the score for each of a term's blocks."""
        new = np.array([b for b in spots.tolist() if b not in self.open], np.int64)
        if len(new):
            doc, tf = unpack(self.data, self.begins[new], self.first[new], self.n[new], self.d_bits[new], self.t_bits[new])
            part = np.repeat(self.idf[new], self.n[new]) * tf * (K1 + 1) / (tf + self.factor[doc])
            ends = np.cumsum(self.n[new]).tolist()
            for b, x, y in zip(new.tolist(), [0, *ends], ends, strict=False):
                self.open[b] = (doc[x:y], part[x:y])
        return map(self.open.__getitem__, spots.tolist())

    def best(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k documents for a query's terms and their scores: MaxScore."""
        lists = [self.at[t] for t in terms if t in self.at]
        lists.sort(key=lambda x: (-self.bound[x[0] : x[1]].max(), x))
        tops = np.array([self.bound[a:z].max() for a, z in lists])
        rest = np.cumsum(tops[::-1])[::-1] if len(tops) else tops
        total, score, least = float(tops.sum()), np.zeros(len(self.key)), 0.0
        for i, ((a, z), top, left) in enumerate(zip(lists, tops.tolist(), rest.tolist(), strict=True)):
            self.met += z - a
            spots = np.arange(a, z)
            if left < least:  # no new document can come in: only those in the running count
                running = np.flatnonzero((score > 0) & (score + left >= least) & self.ok)
                spots = spots[np.searchsorted(running, self.last[a:z], "right") > np.searchsorted(running, self.first[a:z])]
            else:
                spots = spots[self.bound[a:z] + (total - top) >= least]
            self.read += len(spots)
            for doc, part in self.scores(spots):
                score[doc] += part
            if len(lists) > 8 and i % 4 < 3 and i + 4 < len(lists):
                continue  # the bound is taken anew after every fourth term
            found = score[self.ok & (score > 0)]
            if len(found) >= k:
                least = float(np.partition(found, len(found) - k)[len(found) - k]) * (1 - 1e-9)
        found = np.flatnonzero(self.ok & (score > 0) & (score >= least))
        return found, score[found]


def _walk(queries, k: int, n: int, average: float, names: list[str], counts: bool):
    def run(keys, blocks: pa.Table, docs: pa.Table) -> pa.Table:
        if not blocks.num_rows or not docs.num_rows:
            return pa.table({c: pa.nulls(0, t) for c, t in zip(names, kinds(docs), strict=True)})
        s = _Segment(blocks, docs, n, average)
        query, key, score = [], [], []
        for q, terms in queries.value:
            doc, found = s.best(terms, k)
            own = s.key[doc]
            order = np.lexsort((own, -found.round(9)))[:k]
            query += [q] * len(order)
            key.append(own[order])
            score.append(found[order])
        if counts:
            return pa.table({"met": pa.array([s.met], pa.int64()), "read": pa.array([s.read], pa.int64())})
        none = np.zeros(0)
        return pa.table([pa.array(query, kinds(docs)[0]), pa.array(np.concatenate(key) if key else none).cast(pa.int64()), pa.array(np.concatenate(score) if score else none)], names=names)

    def kinds(docs: pa.Table) -> list[pa.DataType]:
        return [pa.int64(), pa.int64()] if counts else [queries_type, pa.int64(), pa.float64()]

    queries_type = queries.kind
    return run


def search(index: DataFrame, terms: DataFrame, query: str, key: str, k: int = LIST_K, allowed: Column | None = None, counts: bool = False) -> DataFrame:
    """BM25 top k of every query over an index: (query, key, score, rank), as :func:`evalloom.operators.retrieval.bm25` gives.

    ``terms`` (query, term) has each term of a query once. Frequencies, count
    and average length are those of the whole index; ``allowed``, a condition on
    the documents' columns, restricts which are listed and stands inside the
    walk. Scores are compared to nine digits, ties go to the smaller key. With
    ``counts`` the result is instead, for each segment, how many blocks its
    queries met and how many were unpacked.
    """
    spark = index.sparkSession
    python_ready(spark)
    docs = documents_of(index)
    n, average = docs.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    hit = index.filter(F.col("term").isNotNull()).drop("docs").join(terms.select("term").distinct(), "term", "left_semi")
    hit = hit.join(hit.groupBy("term").agg(F.sum("n").alias("df")), "term")
    kind = terms.schema[query].dataType
    schema = "met long, read long" if counts else f"{query} {kind.simpleString()}, {key} long, score double"
    names = ["met", "read"] if counts else [query, key, "score"]
    sides = docs.select(F.col("segment").alias("_segment"), "number", "key", "length", (F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)).alias("_ok"))
    groups = max(1, -(-terms.count() // QUERY_TERMS))
    out = None
    for g in range(groups):
        some = terms.filter(F.pmod(F.xxhash64(query), F.lit(groups)) == g) if groups > 1 else terms
        rows = some.groupBy(query).agg(F.sort_array(F.collect_set("term")).alias("_t")).collect()
        told = _Shared(spark.sparkContext.broadcast([(r[query], r["_t"]) for r in rows]), to_arrow_type(kind))
        found = hit.groupBy("segment").cogroup(sides.groupBy("_segment")).applyInArrow(_walk(told, k, n, average or 1.0, names, counts), schema)
        out = found if out is None else out.unionByName(found)
    if counts:
        return out
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key))
    return out.withColumn("rank", nth).filter(F.col("rank") <= k)


class _Shared:
    """A broadcast list of (query, terms) with the Arrow type of its queries."""

    def __init__(self, held, kind: pa.DataType):
        self.held, self.kind = held, kind

    @property
    def value(self):
        return self.held.value
