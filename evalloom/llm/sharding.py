"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get dense numbers 0..N-1 in the order of (id, text hash, size). A
generalised Feistel network permutes Z_a x Z_b, the smallest near-square
product that holds N; a number that falls outside 0..N-1 walks its cycle until
it is inside. Row number -> permuted number p -> shard ``p mod n``, slot
``p div n``: shard and slot of a row follow from its number, N and the seed
alone, and :func:`row_number_at` inverts them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.llm.common import checkpointed, shuffle_partitions

P1, P2 = 2147483647, 2147483629
ROUNDS = 6
SEED = 42


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(multiplier, offset, second multiplier) of each round, from a linear congruential generator."""
    keys, x = [], seed % P1
    for _ in range(rounds):
        key = []
        for _ in range(3):
            x = (x * 48271 + 11) % P1
            key.append(x | 1)
        keys.append(tuple(key))
    return keys


def sides(n: int) -> tuple[int, int]:
    """The factors a, b of the permuted domain: a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute_sql(x: str, n: int, seed: int = SEED, div: str = "div") -> str:
    """SQL text of one pass of the network over the number ``x``; ``div`` is the engine's integer division."""
    a, b = sides(n)
    left, right = f"({x} % {a})", f"({x} {div} {a})"
    for j, (mul, add, mul2) in enumerate(round_keys(seed)):
        side = a if j % 2 == 0 else b
        mixed = f"(((({right} * {mul} + {add}) % {P1}) * {mul2}) % {P2})"
        left, right = right, f"(({left} + {mixed}) % {side})"
    # after an even number of rounds ``left`` is in Z_a and ``right`` in Z_b again
    return f"({right} * {a} + {left})"


def permute(x: int, n: int, seed: int = SEED) -> int:
    """The permutation of one number, with cycle walking, outside of Spark."""
    a, b = sides(n)
    while True:
        left, right = x % a, x // a
        for j, (mul, add, mul2) in enumerate(round_keys(seed)):
            left, right = right, (left + (right * mul + add) % P1 * mul2 % P2) % (a if j % 2 == 0 else b)
        x = right * a + left
        if x < n:
            return x


def row_number_at(shard: int, slot: int, n: int, n_shards: int, seed: int = SEED) -> int:
    """The global row number that stands in a slot of a shard: the inverse permutation."""
    a, b = sides(n)
    x = slot * n_shards + shard
    keys = round_keys(seed)
    while True:
        left, right = x % a, x // a
        for j in reversed(range(len(keys))):
            mul, add, mul2 = keys[j]
            left, right = (right - (left * mul + add) % P1 * mul2 % P2) % (a if j % 2 == 0 else b), left
        x = right * a + left
        if x < n:
            return x


def numbered(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Dense global row numbers ``row_no`` in the order of ``keys`` (nulls first), and the number of rows.

    One range shuffle sorts the narrow rows; the sorted partitions are
    checkpointed, because a second sampling of range bounds could deal them
    differently. Only one count for each partition is summed up in one task.
    """
    spark = df.sparkSession
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = (
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_local": local})
    )
    dealt = checkpointed(dealt)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), "_n")
    total = starts.agg(F.sum("_n")).first()[0] or 0
    joined = dealt.join(starts.drop("_n"), "_part").withColumn("row_no", F.col("_start") + F.col("_local"))
    return joined.drop("_part", "_local", "_start"), int(total)


def shard(docs: DataFrame, n_shards: int = 40, seed: int = SEED) -> DataFrame:
    """Deal documents into ``n_shards`` shards whose row counts differ by one at most.

    Needs ``doc_id`` and ``text``; other columns are not read. Returns doc_id,
    size (UTF-8 bytes + 16), text_crc32, row_no, shard and slot. A null text
    counts as empty; null ids come first in the numbering; rows equal in id and
    text are interchangeable and each gets its own slot; an empty table gives
    no rows.
    """
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"])
    a, b = sides(n)
    outside = a * b - n
    once = F.expr(permute_sql("row_no", n, seed))
    rows = rows.withColumn("_p", once)
    if outside:
        walk = f"aggregate(sequence(1, {outside}), _p, (p, i) -> if(p >= {n}L, {permute_sql('p', n, seed)}, p))"
        rows = rows.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(F.expr(walk)))
    return rows.select(
        "doc_id", "size", "text_crc32", "row_no",
        F.expr(f"cast(_p % {n_shards} as int)").alias("shard"), F.expr(f"_p div {n_shards}").alias("slot"),
    )
