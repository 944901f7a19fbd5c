"""Classes of near-duplicate lists that nothing has joined: each two meet once, and what they are compared by is shuffled once."""

import random
import sys
from itertools import combinations
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from evalloom.llm import near_dup

SCHEMA = "doc_id long, text string"


def families(rnd, seeds, members, words, changed):
    """Texts of a few families whose members are alike, mostly too little to be linked."""
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(seeds):
        seed = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(members):
            w = list(seed)
            for at in rnd.sample(range(words), rnd.choice(changed)):
                w[at] = rnd.choice(vocabulary)
            out.append(" ".join(w))
    return list(enumerate(out))


def shuffled(spark):
    """Bytes that all stages of the session have written to shuffles."""
    bus = spark.sparkContext._jsc.sc()
    bus.listenerBus().waitUntilEmpty()
    stages = bus.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def stages(spark):
    """Stages that the session has begun."""
    bus = spark.sparkContext._jsc.sc()
    bus.listenerBus().waitUntilEmpty()
    jobs = bus.statusStore().jobsList(None)
    return sum(jobs.apply(i).numCompletedStages() for i in range(jobs.size()))


def test_open_lists_are_shuffled_once(spark):
    """Families of similar texts without links: what is shuffled is mostly sketches (9.7 and 11.9 MB in two runs when both sides of the join took them as longs, 5.5 MB now)."""
    rows = families(random.Random(11), 6, 40, 420, [10, 11, 12])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    df.count()
    before = shuffled(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, 3, 0.85).collect()}
    moved = shuffled(spark) - before
    assert got == brute.near(rows, 3, 85)
    assert moved < 7_500_000


def test_blocks_of_open_lists(spark, monkeypatch):
    """Lists dealt in blocks of three, of sets below and above the size that is compared whole."""
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 3)
    rnd = random.Random(12)
    rows = families(rnd, 3, 14, 100, [1, 2, 3, 4]) + [(1000 + i, t) for i, t in families(rnd, 2, 14, 330, [4, 6, 8])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 0.85).collect()}
    assert got == brute.near(rows, 3, 85)


def test_cells_meet_each_two_once(spark):
    side = spark.range(50).select((F.col("id") % 2).alias("value"), F.lit(4).alias("blocks"), F.col("id").alias("node"))
    got = sorted(map(tuple, near_dup.met_in_cells(side, lambda a, b: F.lit(True)).collect()))
    assert got == [p for p in combinations(range(50), 2) if p[0] % 2 == p[1] % 2]


def test_marks(spark):
    """Marks keep the order of the shingles; ``twice`` counts the repeated ones."""
    text = " ".join(f"w{i}" for i in range(500))
    docs = spark.createDataFrame([(1, text), (2, "a b c d")], SCHEMA)
    keys = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.col("doc_id").alias("node"), F.lit(b"x").alias("digest"))
    got = {r["node"]: r for r in near_dup.marks(docs, keys, 3).collect()}
    sets = near_dup.shingle_sets([text.encode(), b"a b c d"], 3)
    for node, s in zip((1, 2), sets, strict=True):
        assert got[node]["marks"] == [(int(x) >> 31) - (1 << 31) for x in s[: near_dup.WIDE]] and got[node]["twice"] == 0


def test_parities_bound_what_is_shared(spark):
    """No two rows share more than their parities allow, and of unlike rows the bound stays far below their sizes."""
    rnd = random.Random(13)
    sets = {i: sorted(rnd.sample(range(1 << 62), 256 - i % 3)) for i in range(6)}
    for i in range(6, 30):
        sets[i] = sorted(rnd.sample(sets[i % 6], 250 - 8 * (i // 6)) + rnd.sample(range(1 << 62), 8 * (i // 6)))
    sets[30] = [(7 << 31) + i for i in range(40)]  # many shingles of one mark
    sets[31] = [(7 << 31) + i for i in range(20, 60)]
    rows = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>").withColumn("marks", F.transform("shingles", lambda x: (F.shiftright(x, 31) - F.lit(1 << 31)).cast("int")))
    wide = near_dup.parities(rows.select("node", "marks", (F.size("marks") - F.size(F.array_distinct("marks"))).alias("twice")))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    met = wide.alias("a").join(wide.alias("b"), a("node") < b("node")).select(a("node"), b("node"), near_dup.most_shared(a, b)).collect()
    assert len(met) == 32 * 31 // 2
    for x, y, most in met:
        same = len(set(sets[x]) & set(sets[y]))
        assert same <= most
        if same == 0 and y < 30:
            assert most < 125


def test_join_of_open_lists_is_compiled(spark):
    """The code that compares classes of a list stays below 8,000 bytes, over which the JVM interprets it; pairs are made once; few stages (111 before, 102 now)."""
    import contextlib
    import io
    import re

    rows = families(random.Random(14), 2, 12, 120, [4, 5])
    seen, repeated, kept = [], [], near_dup.met_in_cells

    def told(side, on):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        with contextlib.redirect_stdout(io.StringIO()) as out:
            (pairs := kept(side, on)).explain("codegen")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        rows = pairs.count()
        repeated.append(rows - pairs.distinct().count())
        seen.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())))
        return pairs

    near_dup.met_in_cells = told
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = stages(spark)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 0.85).collect()}
        took = stages(spark) - before
    finally:
        near_dup.met_in_cells = kept
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == brute.near(rows, 3, 85)
    assert seen and max(seen) < 8000
    assert repeated == [0]
    assert took < 108
