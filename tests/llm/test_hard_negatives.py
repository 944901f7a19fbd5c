"""Hard negatives against all pairs scored in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score long, key long, dims int, rank int"


def brute(rows, n_pos=5, n_neg=5, low=80, high=100, every=100):
    """rows: (vec_id, integers, label)."""
    big, out = 1 << 63, []
    for a, (anchor, q, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), big if i is None else i, same == label, b) for b, (i, v, same) in enumerate(rows) if b != a and v and len(v) == len(q)]
        for s, pos, *_ in sorted(x[:2] for x in scored if x[2])[:n_pos]:
            close = sorted(x[:2] for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s)[:n_neg]
            out += [(anchor, None if pos == big else pos, k + 1, None if i == big else i, -s, -t) for k, (t, i) in enumerate(close)]
    return sorted(out, key=str)


def mined(df, **kw):
    rows = H.usable(df)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in H.mined(rows, F.col("vec_id") % 100 == 0, **kw).collect()), key=str)


def usable(rows):
    return [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, 3, 4) for i, v, y in rows], SCHEMA)


def vectors(n, dims, spread, seed=1):
    rnd = random.Random(seed)
    return [(i, [rnd.randint(-spread, spread) / 256 for _ in range(dims)], rnd.randint(0, 3)) for i in range(n)]


@pytest.mark.parametrize("spread", [2, 200])
def test_against_all_pairs(spark, spread, monkeypatch):
    """Few values give many ties, many values few; small blocks, chunks and groups come in between."""
    rows = vectors(1200, 6, spread)
    for name, value in (("BLOCK_ROWS", 64), ("CHUNK_ROWS", 16), ("CHUNK_ANCHORS", 2), ("GROUP_VALUES", 24), ("SCORED", 8)):
        monkeypatch.setattr(H, name, value)
    assert mined(table(spark, rows).repartition(3)) == brute(usable(rows))
    assert mined(table(spark, rows), positives=2, negatives=7, low=50, high=90) == brute(usable(rows), 2, 7, 50, 90)


def test_odd_rows(spark):
    """Null labels, vectors and components, infinite components, null and repeated ids, other lengths, empty vectors, one vector that a third of the rows have."""
    rows = vectors(900, 5, 40, 2)
    common = [0.5, -0.25, 0.125, 0.0, 0.75]
    rows = [(i, common if i % 3 == 0 else v, y) for i, v, y in rows]
    rows += [(100, common, 1), (100, common, 1), (None, common, 2), (None, common, 1), (7, common, 0), (7, common, 0)]
    rows += [(1000, None, 1), (1100, [None, 1.0, 1.0, 1.0, 1.0], 1), (1200, [float("nan")] * 5, 1), (1300, [float("inf")] * 5, 1), (1400, common, None), (1500, [], 1), (1501, [], 1)]
    rows += [(1600, [1.0, 2.0], 1), (1601, [1.0, 2.5], 1), (1602, [1.0, 2.25], 2), (None, [1.0, 2.25], 2), (1700, [3.0], 3), (-100, common, 3)]
    want = brute(usable(rows))
    assert mined(table(spark, rows)) == want and any(r[0] == 1600 for r in want) and any(r[3] is None for r in want)


def test_nothing_to_mine(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == [] and mined(table(spark, [(100, [1.0], 1), (2, [1.0], 2)])) == []
    with pytest.raises(ValueError):
        mined(table(spark, [(100, [1e30], 1)]))


def test_bounds_hold_and_prune(spark):
    """No score leaves its bounds, and most rows of clustered vectors need no exact score."""
    import numpy as np

    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(8, 16)) * 300
    values = (centres[rnd.integers(0, 8, 2000)] + rnd.normal(size=(2000, 16)) * 20).astype(np.int64)
    edges = [np.unique(np.append(np.quantile(values[:, d], np.arange(64) / 64).astype(np.int64), values[:, d].max() + 1)) for d in range(16)]
    spots = np.arange(10, dtype=np.int64)
    group = H._Group(16, edges, [(0, spots.tobytes(), spots.tobytes(), np.zeros(10, np.int64).tobytes(), values[:10].tobytes())])
    codes = np.array([np.searchsorted(edges[d], values[:, d], "right") - 1 for d in range(16)], np.uint8)
    high, low = group.bounds(group.tables(slice(0, 10)), codes)
    score = values @ values[:10].T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, axis=0)[-5]
    assert (high >= fifth).mean() < 0.25
