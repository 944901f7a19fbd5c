"""The corpus pipeline: stages over whole tables, each written and read again by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; n_chars is that of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import decontamination, line_dedup, near_dup, pieces, quality_rules
from evalloom.llm.token_files import shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, verdicts: DataFrame, row) -> DataFrame:
    """The rows of docs that ``verdicts`` (doc_id, _row) names: by id, nulls included, and by ``row``, so that an id that repeats is judged by row."""
    side = verdicts.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r")).distinct()
    return docs.join(side, (row == F.col("_r")) & docs["doc_id"].eqNullSafe(side["_id"]), "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules and their host pass; equal rows are judged alike, an empty table stays empty."""
    return _keep(docs, quality_rules.judged(docs).filter("kept"), quality_rules.row_key())


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in ten documents or more; a document that would lose all its lines stays whole.

    Such documents are copies or made of common lines only. They are left to the
    next stage, which keeps one of each group.
    """
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    whole = (F.col("n_dropped") > 0) & (F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) == "")
    text = F.when(whole, F.col("text")).otherwise(F.col("kept_text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Texts without words stay, and so do groups without any id; rows that repeat
    an id and its text are one document, of which any one row stays.
    """
    rows = _keep(docs, near_dup.near_duplicates(docs, words=5, threshold=0.8).filter("kept"), F.xxhash64("text"))
    return rows.withColumn("_row", F.xxhash64("text")).dropDuplicates(["doc_id", "_row"]).drop("_row")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit integers), and whether decoding gives the text back."""
    rows = pieces.encoded(docs, pieces.model_path(), with_text=True)
    return rows.select("doc_id", pieces.n_tokens().alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("decontamination", benchmark), ("SentencePiece", encode)]

#: SQL expresses neither sketches and components nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
