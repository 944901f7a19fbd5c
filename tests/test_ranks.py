"""Ranks and percentiles by counts of values against numpy, on skewed groups, ties, nulls and few or no values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import ranks as R
from evalloom.operators import statistics as S

rnd = random.Random(4)
ROWS = [("a", float(int(rnd.gauss(0, 1) * 40)), rnd.gauss(0, 1) ** 5) for _ in range(4000)] + [("b", 7.0, rnd.random()) for _ in range(300)] + [(None, rnd.random(), None) for _ in range(50)] + [("c", None, None), ("d", 1.5, None), ("d", None, 2.5), ("e", -1e300, 1e300), ("e", 1e300, -1e300)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "g string, x double, y double").repartition(5)


def values(group, at):
    return sorted(r[at] for r in ROWS if r[0] == group and r[at] is not None)


def test_places_and_average_ranks(df):
    got = {(r["g"], r["x"]): (r["n"], r["before"]) for r in R.value_places(df, ["g"], "x").collect()}
    ranks = {(r["g"], r["x"]): r["rank"] for r in R.average_ranks(df, ["g"], "x").collect()}
    want = {}
    for g in {r[0] for r in ROWS}:
        found = values(g, 1)
        for v in set(found):
            want[g, v] = (found.count(v), sum(u < v for u in found))
    assert got == want and ranks == {k: before + (n + 1) / 2 for k, (n, before) in want.items()}
    whole = {r["x"]: r["before"] for r in R.value_places(df, [], "x").collect()}
    found = sorted(r[1] for r in ROWS if r[1] is not None)
    assert whole == {v: found.index(v) for v in set(found)}


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_percentiles(df, accuracy):
    """Exact at either precision of the sketch."""
    wanted = {f"{c}{p}": (F.col(c), p / 100) for c in ("x", "y") for p in (0, 10, 50, 95, 100)}
    got = {r["g"]: r for r in R.exact_percentiles(df, ["g"], wanted, accuracy).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for g, r in got.items():
        for at, c in ((1, "x"), (2, "y")):
            for p in (0, 10, 50, 95, 100):
                found = values(g, at)
                assert r[f"{c}{p}"] == (pytest.approx(float(np.percentile(found, p)), rel=1e-12) if found else None)
    one = R.exact_percentiles(df, [], {"m": (F.when(F.col("g") == "a", F.col("y")), 0.37)}, accuracy).collect()
    assert len(one) == 1 and one[0]["m"] == pytest.approx(float(np.percentile(values("a", 2), 37)), rel=1e-12)


def test_nothing(df):
    none = df.filter("g = 'none'")
    assert R.value_places(none, ["g"], "x").count() == 0 and R.exact_percentiles(none, ["g"], {"p": (F.col("x"), 0.5)}).count() == 0
    assert [tuple(r) for r in R.exact_percentiles(none, [], {"p": (F.col("x"), 0.5)}).collect()] == [(None,)]


def test_spearman(spark, df):
    import pandas as pd

    got = {r["g"]: (r["n"], r["rho"]) for r in S.spearman(df, "x", "y", ["g"]).collect()}
    both = {g: pd.DataFrame([r[1:] for r in ROWS if r[0] == g and None not in r[1:]], columns=["x", "y"]) for g in {r[0] for r in ROWS if None not in r[1:]}}
    assert set(got) == set(both) and got["b"] == (300, None)
    for g, pair in both.items():
        rho = pair["x"].rank().corr(pair["y"].rank())
        assert got[g][0] == len(pair) and (got[g][1] is None if np.isnan(rho) else got[g][1] == pytest.approx(rho, rel=1e-9))
