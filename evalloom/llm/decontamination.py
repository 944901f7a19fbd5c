"""Benchmark decontamination with spaced-seed hashes.

A mask is a pattern of 1 and 0; laid over consecutive tokens, only tokens under
a 1 are hashed, so that a substitution under a 0 does not hide a match. Hashes
of benchmark items and of documents are joined; every hit fixes an alignment
(document position minus item position), and each alignment is verified token
by token: within some window of up to ``window`` aligned item tokens, a share of
at least ``min_share`` must agree.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import public

MASKS = ("1110101", "1101011", "10110011")
WINDOW = 20
MIN_SHARE = 0.8
#: Benchmark seeds that are broadcast at most (24 bytes each); more go through a shuffled join.
BROADCAST_SEEDS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as 64-bit hashes; nulls have none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(n: int, min_share: float = MIN_SHARE) -> tuple[str, ...]:
    """Masks for an item of ``n`` tokens that find it with any of the substitutions that ``min_share`` allows: all places of so many zeros."""
    changed = n - -(-n * round(min_share * 1000) // 1000)
    return tuple("".join("0" if i in zeros else "1" for i in range(n)) for zeros in combinations(range(n), changed))


def _seed_rows(df: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """One row for each mask and position: the columns ``keep``, pos and seed; ``df`` has the token hashes in ``_t``."""
    def of(mask: str, spots: list[int]):
        return lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(mask), *[F.get("_t", i + j) for j in spots]).alias("seed"))

    # a mask longer than the text has no position
    spots = lambda mask: F.slice(F.sequence(F.lit(0), F.size("_t")), F.lit(1), F.greatest(F.size("_t") - len(mask) + 1, F.lit(0)))
    every = [F.transform(spots(mask), of(mask, [j for j, c in enumerate(mask) if c == "1"])) for mask in masks]
    return df.filter(F.size("_t") >= min(map(len, masks))).select(*keep, F.inline(F.concat(*every)))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """Verified overlaps, one row for each document and benchmark item that overlap.

    Returns doc_id, _row (a hash of the text, which tells rows with one id
    apart), item_id, at (token position in the document where the item would
    begin, may be negative), n_compared (tokens of the window) and n_equal (the
    most equal tokens of any window). Items shorter than the longest mask are
    searched by masks of their own length, which find them with any substitutions
    that the share allows (one of 5 to 7 tokens; fewer tokens stand whole), as
    long as all their places lie within the text. Null texts and items without tokens have no overlap; equal items are
    searched once and all reported; a repeated row is reported once.
    """
    longest = max(map(len, masks))
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("_t"))
    # a text that ends in a separator has an empty last token, which no other text need have
    items = items.withColumn("_t", F.filter("_t", lambda w: w != F.xxhash64(F.lit(""))))
    items = items.groupBy("_t").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    items = items.withColumn("_item", F.get("item_ids", F.lit(0))).filter(F.size("_t") > 0)
    seeds = _seed_rows(items.filter(F.size("_t") >= longest), ["_item"], masks)
    # at most as many lengths as the longest mask has places; none if no item is so short
    short = tuple(m for r in items.filter(F.size("_t") < longest).select(F.size("_t").alias("n")).distinct().orderBy("n").collect() for m in short_masks(r["n"], min_share))
    for mask in short:
        seeds = seeds.unionByName(_seed_rows(items.filter(F.size("_t") == len(mask)), ["_item"], (mask,)))
    seeds = seeds.withColumnRenamed("pos", "_ipos").distinct()
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)

    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), "text")
    hashed = base.select("doc_id", "_row", tokens(F.col("text")).alias("_t"))
    hits = (
        _seed_rows(hashed, ["doc_id", "_row"], (*masks, *short)).join(seeds, "seed")
        .select("doc_id", "_row", "_item", (F.col("pos") - F.col("_ipos")).alias("at")).distinct()
    )
    by_doc = hits.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("_item", "at")).alias("_hits"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), "_hits")
    matched = base.join(by_doc.hint("shuffle_hash"), (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    matched = matched.select("doc_id", "_row", tokens(F.col("text")).alias("_t"), F.explode("_hits").alias("_hit"))
    lined = matched.select("doc_id", "_row", "_hit._item", "_hit.at", F.col("_t").alias("_dt")).join(
        items.select("_item", "item_ids", F.col("_t").alias("_it")), "_item"
    )
    # the document's tokens under the item: nothing where the item hangs over an end
    equal = F.transform("_it", lambda w, i: F.when(F.get("_dt", F.col("at") + i) == w, 1).otherwise(0))
    width = F.least(F.size("_it"), F.lit(window))
    lined = lined.select("doc_id", "_row", "item_ids", "at", width.alias("n_compared"), equal.alias("_eq"))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("_eq") - F.col("n_compared") + 1),
        lambda s: F.aggregate(F.slice("_eq", s, F.col("n_compared")), F.lit(0), lambda acc, x: acc + x),
    )
    lined = lined.select("doc_id", "_row", "item_ids", "at", "n_compared", F.array_max(sums).alias("n_equal"))
    # whole numbers on both sides: the share is compared in thousandths
    lined = lined.filter(F.col("n_equal") * 1000 >= F.col("n_compared") * round(min_share * 1000))
    best = F.max(F.struct("n_equal", (-F.col("at")).alias("_at"), "n_compared")).alias("b")
    found = lined.select("doc_id", "_row", F.explode("item_ids").alias("item_id"), "at", "n_compared", "n_equal")
    return found.groupBy("doc_id", "_row", "item_id").agg(best).select(
        "doc_id", "_row", "item_id", (-F.col("b._at")).alias("at"), "b.n_compared", "b.n_equal"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that overlap with no benchmark item, with all columns that do not begin with an underscore."""
    docs = public(docs)
    found = overlaps(docs, benchmark, **params).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r")).distinct()
    row = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, (row == F.col("_r")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")
