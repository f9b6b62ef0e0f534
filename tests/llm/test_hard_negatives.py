"""Hard negatives against a slow version in Python integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgelab.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, every=3, positives=5, negatives=3):
    used = [
        (i, [max(min(math.floor(256 * float(np.float32(x))), hn.MOST), hn.NONE) for x in v], y)
        for i, v, y in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]

    def score(a, b):
        return max(min(sum(x * y for x, y in zip(a, b, strict=False)), hn.MOST), hn.NONE)

    out = []
    for i, v, y in used:
        if i % every:
            continue
        others = sorted((-score(v, w), j, z) for j, w, z in used if j != i)
        for s, j, _ in [o for o in others if o[2] == y][:positives]:
            hard = [(o[1], -o[0]) for o in others if o[2] != y and -50 * s <= -100 * o[0] <= -95 * s]
            out += [(i, j, r, n, -s, t) for r, (n, t) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def mined(df, every=3, **settings):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = hn.mine(df, F.col("vec_id") % every == 0, **settings)
    return sorted(tuple(r) for r in found.select(*columns).collect())


def clustered(n=400, dimension=9, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dimension))
    labels = rng.integers(0, 4, n)
    points = centres[rng.integers(0, 8, n)] + rng.normal(scale=0.2, size=(n, dimension))
    return [(i, points[i].astype(np.float32).tolist(), int(labels[i])) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"block": 16, "anchors_at_once": 40}])
def test_by_brute_force(spark, settings):
    rows = clustered()
    expected = slow(rows)
    assert expected
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3), **settings) == expected


def test_many_ties_and_repeated_rows(spark):
    rows = [(i, [1.0, (i % 3) / 4], i % 2) for i in range(60)] + [(4, [1.0, 0.25], 1), (5, [0.75, 0.5], 1), (6, [1.0, 0.5], 0)] * 4
    assert mined(spark.createDataFrame(rows, SCHEMA), block=8) == slow(rows)


def test_awkward_rows(spark):
    rows = clustered(60) + [
        (None, [1.0] * 9, 1),
        (300, None, 1),
        (301, [1.0] * 9, None),
        (302, [1.0, None], 1),
        (303, [float("nan")], 1),
        (306, [float("inf")] * 9, 1),
        (309, [], 1),
        (312, [0.0] * 9, 2),
        (315, [0.5, -0.5], 0),
        (318, [2.0] * 12, 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "asks", "KEY", "cell", "vector", "salt"):
        df = df.selectExpr("*", f"'x' AS {name}")
    assert mined(df) == slow(rows)
    assert mined(df.limit(0)) == []


def test_products_beyond_doubles_and_longs(spark):
    big = [(i, [float(2**26 + i), 1.0 + i, 3.0], i % 2) for i in range(12)]
    assert mined(spark.createDataFrame(big, SCHEMA)) == slow(big)
    huge = [(i, [1e30 if i % 4 else -1e30, float(i)], i % 2) for i in range(8)]
    assert mined(spark.createDataFrame(huge, SCHEMA)) == slow(huge)


def test_curve_goes_from_neighbour_to_neighbour():
    for dimensions, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dimensions)).reshape(dimensions, -1).astype(np.uint32)
        keys = hn.hilbert_keys(points, bits)
        assert len(set(keys)) == side**dimensions
        walk = points[:, np.argsort(np.array(keys, dtype=object))].astype(int)
        assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_bounds_hold_and_skip_blocks():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 300
    points = np.floor(np.concatenate([c + rng.normal(size=(50, 6)) for c in centres])).astype(np.int64)
    asked = hn.Asked(np.arange(1), np.zeros(1), points[:1], np.full((1, 1), 0), np.full((1, 1), hn.MOST), True, 1)
    asked.low[:] = hn.products(points[:1], points[1:50]).max()
    reached = 0
    for start in range(0, 1000, 50):
        block = points[start : start + 50]
        least, most = asked.bounds(block.min(axis=0), block.max(axis=0))
        scores = hn.products(points[:1], block)
        assert least[0] <= scores.min() and scores.max() <= most[0]
        reached += int(asked.needs(block.min(axis=0), block.max(axis=0))[0])
    assert reached <= 5
