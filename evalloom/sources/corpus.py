"""Stored objects, small JSON books, pages of chunks and batches of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.sources.session import python_ready

#: Bytes of a file that is one value at most, and of a piece of a larger one.
WHOLE, PIECE = 1 << 25, 1 << 22
#: Endings that Spark's line reader would decompress: such files are one value (2 GB at most).
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst", "passthrough")
_MARK = b"\xef\xbb\xbf"


def stored_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(org_id, document_id, digest, size) of the files <folder>/<org>/<document>.<ending>; one file for each document. Spark lists no empty file.

    Files of over ``WHOLE`` bytes are read in pieces, see :func:`_large_digests`.
    """
    names = {"pathGlobFilter": f"*.{{{','.join(PACKED)}}}"}
    whole = lambda some, **options: spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(folder).filter(some).select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))
    files = whole(F.col("length") <= WHOLE).unionByName(whole(F.col("length") > WHOLE, **names)).unionByName(_large_digests(spark, folder))
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return files.select(F.element_at(parts, -2).alias("org_id"), name.alias("document_id"), "digest", "size")


def _large_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, digest, size) of the files over ``WHOLE`` bytes, whatever they hold.

    Blocks of a file are read by many tasks as what stands between line feeds,
    put together in pieces, and hashed in order by one task a file, since a
    SHA-256 goes on from what came before; a task holds some pieces. Only a run
    of 2 GB without a line feed is too long for the reader.
    """
    python_ready(spark)
    lines = spark.read.option("recursiveFileLookup", "true").text(folder, lineSep="\n")
    at, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    lines = lines.filter((size > WHOLE) & ~at.rlike(rf"\.(?:{'|'.join(PACKED)})$")).select(at.alias("path"), size.alias("size"), F.col("_metadata.file_block_start").alias("start"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"))
    piece = "path string, size long, start long, n long, data binary"
    pieces = lines.mapInArrow(_pieces, piece).repartition("path").sortWithinPartitions("path", "start", "n")
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # paths of metadata are encoded, those of whole files are not
    return pieces.mapInArrow(_digests, "path string, digest string, size long").withColumn("path", path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each block, which follow each other, as numbered pieces."""
    block, n = None, 0
    for batch in batches:
        paths, starts = batch.column("path").dictionary_encode(), np.asarray(batch.column("start"))
        codes = np.asarray(paths.indices)
        cuts = np.flatnonzero((np.diff(starts, prepend=-1) != 0) | (np.diff(codes, prepend=-1) != 0))
        lines = batch.column("data").cast(pa.large_binary())
        _, offsets, data = lines.buffers()
        ends = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
        for first, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            own = (batch.column("path")[first].as_py(), batch.column("size")[first].as_py(), int(starts[first]))
            block, n = own, n if own == block else 0
            for x in range(int(ends[first]), int(ends[stop]), PIECE):
                part = data[x : min(x + PIECE, int(ends[stop]))]
                yield pa.RecordBatch.from_pydict({"path": [own[0]], "size": [own[1]], "start": [own[2]], "n": [n], "data": pa.array([part.to_pybytes()], pa.binary())})
                n += 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each path of sorted pieces.

    The reader tells neither whether the last line had a feed nor whether a byte
    order mark stood first; the file's size does, once all is read.
    """
    path = None

    def end() -> pa.RecordBatch:
        missing = size - total
        if missing not in (-1, 0, 2, 3):
            raise ValueError(f"{path} has {size} bytes, but {total} were read")
        found = plain if missing < 1 else marked
        if missing in (0, 3):
            found.update(held)
        return pa.RecordBatch.from_pydict({"path": [path], "digest": [found.hexdigest()], "size": [size]})

    for batch in batches:
        for k in range(batch.num_rows):
            if (now := batch.column("path")[k].as_py()) != path:
                if path is not None:
                    yield end()
                path, size, total, held = now, batch.column("size")[k].as_py(), 0, b""
                plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)
            data = batch.column("data")[k].as_buffer()
            for found in (plain, marked):
                found.update(held)
                found.update(data[:-1])
            held, total = data[len(data) - 1 :].to_pybytes(), total + len(data)
    if path is not None:
        yield end()


def without_documents(objects: DataFrame, gone: DataFrame) -> DataFrame:
    """The objects that stay when documents (org_id, document_id) go."""
    return objects.join(gone, ["org_id", "document_id"], "left_anti")


def golden_cases(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """One row for each JSON line that is not blank; fields that the schema does not name are left out, a broken line is an error."""
    return lines.filter(F.trim(value) != "").select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def price_book(book: DataFrame, text: str = "value") -> DataFrame:
    """(model, tier, input, cached, output) of a nested JSON book {model: {tier: {rate: number}}}; notes beside the tiers are left out."""
    models = book.select(F.explode(F.from_json(text, "map<string,string>")).alias("model", "tiers"))
    tiers = models.select("model", F.explode(F.from_json("tiers", "map<string,string>")).alias("tier", "rates"))
    rate = lambda n: F.get_json_object("rates", f"$.{n}").cast("decimal(20,10)")
    return tiers.select("model", "tier", rate("input").alias("input"), F.coalesce(rate("cached_input"), rate("input")).alias("cached"), rate("output").alias("output")).filter(F.col("input").isNotNull())


def chunk_pages(chunks: DataFrame, key: str, by: str, size: int = 500) -> DataFrame:
    """Each document's chunks with the page that a paged reader finds them on: so many a page, from 0."""
    from pyspark.sql.window import Window

    return chunks.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(by)) - 1) / size).cast("int"))


# --- sinks


def append_batches(rows: DataFrame, path: str, most: int = 200_000) -> None:
    """Append rows in files of at most ``most`` rows, so that no writer holds a large batch."""
    rows.write.mode("append").option("maxRecordsPerFile", most).parquet(path)
