"""Similar token sets without a join on frequent tokens.

Tokens are ordered by how few sets have them. Two sets that are as similar as
asked must share a token among the first few of each, the rarest: how many
follows from the threshold and the size. Only those are joined; sizes and the
places of the shared token rule out most of what meets, and what is left is
verified on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.sources.session import joined_by, written

#: Thresholds by which the most similar set is sought; what has none yet at the last one is joined on all its tokens.
LEVELS = (0.8, 0.4, 0.1)
_EPS = 1e-9


def ordered_sets(df: DataFrame, by: list[str], key: str, tokens: str) -> DataFrame:
    """(by, key, size, tokens): each set's distinct tokens, those that fewest sets of the group have first. Null and empty sets are left out."""
    each = df.select(*by, key, F.explode(F.array_distinct(tokens)).alias("_t")).filter(F.col("_t").isNotNull())
    common = each.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("_f"))
    rows = joined_by(each, common, [*by, "_t"]).groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("_f", "_t"))).alias("_s"))
    return written(rows.select(*by, key, F.size("_s").alias("size"), F.transform("_s", lambda x: x["_t"]).alias("tokens")))


def _places(sets: DataFrame, by: list[str], key: str, names: tuple[str, str, str], first: Column) -> DataFrame:
    """(by, renamed key, size, place, token): the first tokens of each set."""
    k, n, at = names
    return sets.select(*by, F.col(key).alias(k), F.col("size").alias(n), F.posexplode(F.slice("tokens", 1, first)).alias(at, "_t"))


def _verified(pairs: DataFrame, sets: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key, other, size, m, shared) of distinct pairs."""
    a = sets.select(*by, key, "size", F.col("tokens").alias("_x"))
    b = sets.select(*by, F.col(key).alias("other"), F.col("size").alias("m"), F.col("tokens").alias("_y"))
    both = pairs.distinct().join(a, [*by, key]).join(b, [*by, "other"])
    return both.select(*by, key, "other", "size", "m", F.size(F.array_intersect("_x", "_y")).alias("shared"))


def similar_pairs(sets: DataFrame, by: list[str], key: str, least: float, left: DataFrame | None = None) -> DataFrame:
    """(by, key, other, jaccard) of pairs of different keys with a Jaccard of at least ``least`` (over 0), both ways round; ``left`` restricts the keys."""
    need = lambda n: F.ceil(F.lit(least) * n - _EPS)
    prefix = (F.col("size") - need(F.col("size")) + 1).cast("int")
    a = _places(sets if left is None else sets.join(left, [*by, key], "left_semi"), by, key, (key, "_n", "_i"), prefix)
    b = _places(sets, by, key, ("other", "_m", "_j"), prefix)
    shared = F.ceil(F.lit(least / (1 + least)) * (F.col("_n") + F.col("_m")) - _EPS)
    fits = (F.col("_m") >= need(F.col("_n"))) & (F.col("_n") >= need(F.col("_m"))) & (F.least(F.col("_n") - F.col("_i"), F.col("_m") - F.col("_j")) >= shared)
    met = a.join(b, [*by, "_t"]).filter((F.col(key) != F.col("other")) & fits).select(*by, key, "other")
    jaccard = F.col("shared") / (F.col("size") + F.col("m") - F.col("shared"))
    return _verified(met, sets, by, key).select(*by, key, "other", jaccard.alias("jaccard")).filter(F.col("jaccard") >= least - _EPS)


def contained_pairs(sets: DataFrame, by: list[str], key: str, least: float) -> DataFrame:
    """(by, key, other, contained, jaccard) of pairs of which at least ``least`` of the smaller set is in the larger, both ways round."""
    prefix = (F.col("size") - F.ceil(F.lit(least) * F.col("size") - _EPS) + 1).cast("int")
    a = _places(sets, by, key, (key, "_n", "_i"), prefix)  # the smaller set's rarest tokens
    b = _places(sets, by, key, ("other", "_m", "_j"), F.col("size"))
    met = a.join(b, [*by, "_t"]).filter((F.col(key) != F.col("other")) & (F.col("_n") <= F.col("_m"))).select(*by, key, "other")
    met = met.unionByName(met.select(*by, F.col("other").alias(key), F.col(key).alias("other")))
    jaccard = F.col("shared") / (F.col("size") + F.col("m") - F.col("shared"))
    rows = _verified(met, sets, by, key).select(*by, key, "other", (F.col("shared") / F.least("size", "m")).alias("contained"), jaccard.alias("jaccard"))
    return rows.filter(F.col("contained") >= least - _EPS)


def nearest_sets(df: DataFrame, key: str, tokens: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(key, other, jaccard): the most similar other set of each, of equal ones the smaller key; sets that share nothing have none.

    Found level by level: a set with a partner at a level has its best one there,
    and only the others go on. Keys are distinct and not null.
    """
    sets = ordered_sets(df, [], key, tokens)
    left, out = sets.select(key), []
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("jaccard"), "other"))
    for least in levels:
        found = written(similar_pairs(sets, [], key, least, left).withColumn("_nth", nth).filter("_nth = 1").drop("_nth"))
        out.append(found)
        left = written(left.join(found, key, "left_anti"))
        if left.isEmpty():
            break
    else:
        a = _places(sets.join(left, key, "left_semi"), [], key, (key, "_n", "_i"), F.col("size"))
        b = _places(sets, [], key, ("other", "_m", "_j"), F.col("size"))
        counts = a.join(b, "_t").filter(F.col(key) != F.col("other")).groupBy(key, "other", "_n", "_m").agg(F.count(F.lit(1)).alias("_c"))
        rest = counts.select(key, "other", (F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c"))).alias("jaccard"))
        out.append(rest.withColumn("_nth", nth).filter("_nth = 1").drop("_nth"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
