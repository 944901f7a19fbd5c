"""Similar sets against all pairs, on skewed tokens."""

import random

import pytest

from evalloom.operators import set_similarity as S

rnd = random.Random(6)
SETS = {i: {f"t{int(rnd.paretovariate(0.6)) % 300}" for _ in range(rnd.randint(1, 25))} | {"the"} for i in range(220)}
SETS |= {300 + i: set(list(SETS[i])[: len(SETS[i]) * 3 // 4 + 1]) for i in range(60)} | {400: {"alone"}, 401: {"pair", "x"}, 402: {"pair", "y", "z"}, 403: SETS[5], 404: SETS[5]}
ROWS = [(i, i % 3 if i < 400 else 9, sorted(s) + sorted(s)[:2]) for i, s in SETS.items()] + [(500, 0, []), (501, 0, None), (502, 0, [None])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k int, g int, t array<string>")


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [1.0, 0.8, 0.5, 0.34, 0.05])
def test_pairs(df, least):
    sets = S.ordered_sets(df, [], "k", "t")
    got = {(r["k"], r["other"]): r["jaccard"] for r in S.similar_pairs(sets, [], "k", least).collect()}
    want = {(i, j): jaccard(a, b) for i, a in SETS.items() for j, b in SETS.items() if i != j and jaccard(a, b) >= least - 1e-9}
    assert got == pytest.approx(want) and (403, 404) in got


@pytest.mark.parametrize("least", [1.0, 0.5])
def test_contained_within_groups(df, least):
    sets = S.ordered_sets(df, ["g"], "k", "t")
    got = {(r["k"], r["other"]): (r["contained"], r["jaccard"]) for r in S.contained_pairs(sets, ["g"], "k", least).collect()}
    group = {i: g for i, g, _ in ROWS}
    want = {(i, j): (len(a & b) / min(len(a), len(b)), jaccard(a, b)) for i, a in SETS.items() for j, b in SETS.items() if i != j and group[i] == group[j] and len(a & b) / min(len(a), len(b)) >= least - 1e-9}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_nearest(spark, df):
    got = {r["k"]: (r["other"], r["jaccard"]) for r in S.nearest_sets(df, "k", "t").collect()}
    want = {}
    for i, a in SETS.items():
        best = sorted((-jaccard(a, b), j) for j, b in SETS.items() if j != i and a & b)
        if best:
            want[i] = (best[0][1], pytest.approx(-best[0][0]))
    assert got == want and 400 not in got and got[401][0] == 402
    assert S.nearest_sets(df.filter("k = 1"), "k", "t").count() == 0 and S.nearest_sets(df.limit(0), "k", "t").count() == 0


def test_only_rare_tokens_are_joined(df):
    """Of sets that share a token nearly all have, few meet."""
    sets = S.ordered_sets(df, [], "k", "t")
    prefix = lambda s: s[: len(s) - -(-8 * len(s) // 10) + 1]
    rows = [r["tokens"] for r in sets.collect()]
    assert sum("the" in r for r in rows) > 150 and sum("the" in prefix(r) for r in rows if len(r) > 5) == 0
