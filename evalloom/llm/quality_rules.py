"""Quality rules of documents and of their hosts.

Each text is measured once. Failures of the rules are summed up by host, each
host's failure rate is shrunk towards a beta prior fitted to the rates of all
hosts (method of moments), and hosts whose shrunk rate is too high reject their
documents through a join of the small verdict table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import checkpointed, python_ready
from evalloom.llm.profile import rule_counts

#: A host is rejected if its shrunk failure rate is above this share.
MAX_HOST_RATE = 0.5
#: Host verdicts that are broadcast at most (some 50 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 1_000_000
COUNTS = ("n_words", "n_spaces", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")


def _measure(batches):
    for batch in batches:
        rows = [rule_counts(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("_bytes")]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        arrays = [*(batch.column(c) for c in ("doc_id", "_row", "host", "_chars")), *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_row", "host", "_chars", *COUNTS])


def row_key(host: str = "source") -> Column:
    """A hash of all that a verdict depends on; rows with one id and one key have one verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text, F.octet_length(text), F.coalesce(F.col(host).cast("string"), F.lit("")), F.col(host).isNull())


def base_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, _row, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed.

    Needs doc_id, text and the host's column. A null text has no words and
    fails. rule_failed also holds a softer rule that counts against the host only:
    symbols over a tenth of the characters in words. ``_row`` is
    :func:`row_key`, by which a verdict finds its row where an id repeats.
    """
    python_ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", row_key(host).alias("_row"), F.col(host).cast("string").alias("host"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("_chars"), F.col("text").cast("binary").alias("_bytes"))
    schema = f"doc_id {kind}, _row long, host string, _chars long, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = slim.mapInArrow(_measure, schema).withColumn("word_chars", F.col("_chars") - F.col("n_spaces"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    soft = 10 * F.col("n_symbols") > F.col("word_chars")
    return rows.select(
        "doc_id", "_row", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (failed | soft).alias("rule_failed"),
    )


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk) and host_rejected of every host that is not null.

    The prior has the mean m and variance v of the hosts' rates: a + b =
    m (1 - m) / v - 1, held to at least 1. If the rates do not vary, the prior
    outweighs any host and every rate is m.
    """
    hosts = rules.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("rule_failed").alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("_m"), F.var_pop(rate).alias("_v"))
    weight = F.when(F.col("_v") > 0, F.greatest(F.lit(1.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1)).otherwise(F.lit(1e12))
    shrunk = (F.col("host_failed") + F.col("_m") * F.col("_w")) / (F.col("host_docs") + F.col("_w"))
    return (
        hosts.crossJoin(F.broadcast(prior.withColumn("_w", weight)))  # the prior is one row
        .withColumn("host_rate", shrunk)
        .select("host", "host_docs", "host_failed", "host_rate", (F.col("host_rate") > max_rate).alias("host_rejected"))
    )


def judged(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """:func:`base_rules` with the host's verdict and kept.

    A document without host is judged by its own rules alone. Repeated rows are
    judged alike; an empty table gives no rows.
    """
    rules = checkpointed(base_rules(docs, host))  # narrow rows; the texts are measured once
    verdicts = checkpointed(host_verdicts(rules, max_rate).select("host", "host_rejected"))
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)  # so that a host with a third of all rows meets no single task
    both = rules.join(verdicts, "host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return both.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~rejected)
