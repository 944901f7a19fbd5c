"""Removal of lines that stand in many documents.

The 128-bit hashes of normalised lines are range-partitioned with a secondary
sort by document and position; the first occurrence of each line in each
document streams out of the sorted partitions and is counted. What comes back
is one run-length keep bitmap for each document that loses lines, never text;
:func:`apply_bitmaps` turns bitmaps and documents into the kept text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.llm.common import SPACES, ascii_lower, checkpointed, public, shuffle_partitions


def _identified(docs: DataFrame) -> DataFrame:
    """A document is an id with a text: rows that repeat both are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_row", F.xxhash64(text, F.octet_length(text)))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, _row, keep_runs) of the documents that lose lines.

    keep_runs has the lengths of alternating runs over the lines: kept, dropped,
    kept, and so on, beginning with kept (which may be 0) and ending with the
    last dropped run. A line is compared by its key: white space stripped at
    both ends, A-Z lower-cased. Keys shorter than ``min_chars`` stay; null texts
    are one empty line; a repeated row is the same document and counts once.
    """
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    lines = (
        _identified(docs)
        .select("doc_id", "_row", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
        .withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    # splitting and hashing every line once: it is read for the range bounds, for the counts and for the bitmaps
    lines = checkpointed(lines)
    dealt = lines.repartitionByRange(shuffle_partitions(docs.sparkSession), "h1", "h2", "doc_id", "_row")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id", "_row").orderBy("pos"))
    # written, so that the join below has a plain shuffle on both sides and a hot line's rows can be split
    common = checkpointed(
        dealt.withColumn("_nth", first).filter("_nth = 1").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs).select("h1", "h2")
    )
    lost = lines.join(common, ["h1", "h2"], "left_semi")
    spots = lost.groupBy("doc_id", "_row").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    spots = spots.select(
        "doc_id", "_row",
        F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1)).alias("first"),
        F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1)).alias("last"),
    )
    runs = F.transform(
        "first", lambda s, i: F.array(s - F.when(i == 0, F.lit(0)).otherwise(F.get("last", i - 1) + 1), F.get("last", i) - s + 1)
    )
    return spots.select("doc_id", "_row", F.flatten(runs).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with n_lines, n_dropped, keep_runs and kept_text; a document without bitmap keeps all lines.

    Columns of ``docs`` with these names are replaced, and columns that begin with an underscore are not kept.
    """
    side = bitmaps.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_side"), F.col("keep_runs").alias("_runs"))
    base = _identified(public(docs).drop("n_lines", "n_dropped", "keep_runs", "kept_text"))
    both = base.join(side.hint("shuffle_hash"), (F.col("_row") == F.col("_side")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = F.flatten(F.transform("_runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    both = both.withColumn("_lines", F.split(text, "\n", -1)).withColumn("_flags", flags)
    kept = F.array_join(F.zip_with("_lines", "_flags", lambda line, keep: F.when(F.coalesce(keep, F.lit(True)), line)), "\n")
    dropped = F.aggregate(F.zip_with("_runs", F.sequence(F.lit(1), F.size("_runs")), lambda n, i: F.when(i % 2 == 0, n).otherwise(0)), F.lit(0), lambda s, n: s + n)
    return both.select(
        *base.drop("_row").columns,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_runs").alias("keep_runs"),
        F.when(F.col("_runs").isNull(), text).otherwise(kept).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Whole documents through both halves; see :func:`keep_bitmaps` and :func:`apply_bitmaps`."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars))
