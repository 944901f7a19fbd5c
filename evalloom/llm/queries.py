"""The thin ``opN_`` queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import alignment, bradley_terry, decontamination, hard_negatives, licenses, line_dedup, main_text, near_dup, pieces, quality_rules, sharding, suffix_dedup, token_files
from evalloom.llm.common import documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "at", "n_compared", "n_equal")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules.judged(documents(spark, sf_dir))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(documents(spark, sf_dir), pieces.model_path())
    return rows.select("doc_id", pieces.n_tokens().alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), 10, 1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.shared_path(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path, token_files.tokenizer_path(), end_id=1)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.without_repeats(documents(spark, sf_dir), 400)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.found(documents(spark, sf_dir))


def op9_bottom_k_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), words=3, threshold=0.85).drop("_row")


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bradley_terry.scored(docs, bradley_terry.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.groups(documents(spark, sf_dir), *alignment.tokenizer_paths())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.scored(rows.withColumn("groups_sha256", digest).drop("groups"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = main_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_feistel_sharding, op4_sentencepiece, op5_line_dedup, op6_token_files, op7_suffix_dedup, op8_license_scan, op9_bottom_k_near_dup, op10_bradley_terry, op11_hard_negatives, op12_token_alignment, op13_main_text)}
