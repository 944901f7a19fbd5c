"""Resampling over value counts: against drawing the values themselves, by every sign, and on other partitionings."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from evalloom.operators import resampling as R
from evalloom.plans import QUERIES
from evalloom.sources.standins import duck

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(8)
GROUPS = {"many": rng.normal(3, 2, 600).round(2), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([4.0]), "equal": np.full(30, 2.5), "few": np.array([0.5, -0.2, 0.3, 0.0, 0.9, 0.1]), "zeros": np.zeros(5), "large": rng.normal(0.05, 1, 2000)}
ROWS = [(g, float(x)) for g, v in GROUPS.items() for x in v] + [("many", None), ("none", None), (None, 1.0), (None, 2.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "g string, x double")


def plain_bootstrap(v, rounds, seed):
    means = np.random.default_rng(seed).choice(v, (rounds, len(v))).mean(axis=1)
    return np.percentile(means, [2.5, 97.5])


@pytest.mark.parametrize("block", [4096, 50])
def test_intervals(df, monkeypatch, block):
    """The same at any number of partitions; close to resampling the values; values in several blocks are no different."""
    monkeypatch.setattr(R, "BLOCK_VALUES", block)
    got = {r["g"]: r for r in R.bootstrap_means(df.repartition(3), ["g"], "x", "salt").collect()}
    again = {r["g"]: r for r in R.bootstrap_means(df.repartition(7, "x"), ["g"], "x", "salt").collect()}
    assert {g: (r["n"], r["low"], r["high"]) for g, r in got.items()} == {g: (r["n"], r["low"], r["high"]) for g, r in again.items()} and set(got) == {*GROUPS, "none", None}
    for g, v in GROUPS.items():
        r = got[g]
        assert r["n"] == len(v) and r["mean"] == pytest.approx(v.mean(), abs=1e-9)
        low, high = plain_bootstrap(v, 20_000, 1)
        assert [r["low"], r["high"]] == pytest.approx([low, high], abs=0.1 * (high - low) + 1e-9)
    assert tuple(got["none"])[1:] == (0, None, None, None) and got["equal"]["low"] == got["equal"]["high"] == 2.5 and got[None]["n"] == 2
    other = {r["g"]: r["low"] for r in R.bootstrap_means(df, ["g"], "x", "other").collect()}
    assert other["many"] != got["many"]["low"] and other["one"] == 4.0


def test_one_block_is_a_multinomial_draw(df):
    """The draw itself, by the stated seed."""
    r = next(r for r in R.bootstrap_means(df, ["g"], "x", "salt").collect() if r["g"] == "ties")
    values, counts = np.unique(GROUPS["ties"], return_counts=True)
    seed = int.from_bytes(hashlib.sha256("\x1f".join(("salt", "ties", "block", "0")).encode()).digest()[:8], "big")
    own, means = np.random.default_rng(seed), []
    for _ in range(20):
        means.append(own.multinomial(np.full(100, 400), counts / 400) @ values / 400)
    assert [r["low"], r["high"]] == pytest.approx(list(np.percentile(np.concatenate(means), [2.5, 97.5])), abs=1e-9)


@pytest.mark.parametrize("block", [4096, 50])
def test_sign_flips(df, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_VALUES", block)
    got = {r["g"]: r["p"] for r in R.flip_tests(df.repartition(3), ["g"], "x", "salt").collect()}
    assert got == {r["g"]: r["p"] for r in R.flip_tests(df.repartition(5, "x"), ["g"], "x", "salt").collect()}
    live = GROUPS["few"][GROUPS["few"] != 0]
    sums = [abs(sum(x * (1 if k >> i & 1 else -1) for i, x in enumerate(live))) for k in range(1 << len(live))]
    assert got["few"] == np.mean([s >= abs(live.sum()) - 1e-9 for s in sums]) and got["zeros"] == got["none"] == 1.0 and got["one"] == 1.0 and got[None] == 0.5
    assert got["many"] == 1 / (R.PERMUTATIONS + 1)
    d = GROUPS["large"]
    flips = np.abs((np.random.default_rng(2).integers(0, 2, (4000, len(d))) * 2 - 1) @ d)
    assert got["large"] == pytest.approx((flips >= abs(d.sum())).mean(), abs=0.03)


def test_nothing(df):
    none = df.filter("g = 'nobody'")
    assert R.bootstrap_means(none, ["g"], "x", "s").count() == 0 and R.flip_tests(none, ["g"], "x", "s").count() == 0


def test_queries(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    values, paired = defaultdict(list), defaultdict(list)
    for run, kind, x in con.execute(duck("run_scores") + " SELECT run, type, faithfulness FROM run_scores").fetchall():
        values[run, kind].append(x)
    got = QUERIES["sta04_bootstrap"](spark, SF).collect()
    assert {(r["run"], r["type"]) for r in got} == set(values)
    for r in got:
        v = np.array(values[r["run"], r["type"]])
        low, high = plain_bootstrap(v, 10_000, 1)
        assert r["n"] == len(v) and r["mean"] == pytest.approx(v.mean()) and [r["low"], r["high"]] == pytest.approx([low, high], abs=0.1 * (high - low))
    for flag, x in con.execute(duck("run_scores") + " SELECT a.flag, b.faithfulness - a.faithfulness FROM run_scores a JOIN run_scores b USING (case_key) WHERE a.run = 'A' AND b.run = 'B' AND a.status = 'done' AND b.status = 'done'").fetchall():
        paired[flag].append(x)
    got = QUERIES["sta05_paired_continuous"](spark, SF).collect()
    assert {r["flag"]: r["n"] for r in got} == {k: len(v) for k, v in paired.items()}
    assert all(r["delta"] == pytest.approx(np.mean(paired[r["flag"]])) and r["low"] <= r["delta"] <= r["high"] and 0 < r["p"] <= 1 for r in got)
