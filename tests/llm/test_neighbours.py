from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgelab.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, Score int"


def _exact(rows, query, k):
    own = next(np.array(v, dtype=float) for i, v, _ in rows if i == query)
    scored = [(-float(np.dot(np.array(v, dtype=float), own)), i) for i, v, _ in rows if i != query]
    return [i for _, i in sorted(scored)[:k]]


def test_rotations_keep_angles():
    turns = neighbours.Rotations(20, 2)
    x = np.random.default_rng(1).normal(size=(5, 20))
    assert np.allclose(turns.turn(x, 0) @ turns.turn(x, 0).T, x @ x.T)
    assert turns.axes(x, 1, 3).shape == (5, 3)


@pytest.mark.parametrize("block", [7, 8192])
def test_recall_for_unequal_lengths_and_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(300, 16)) * draw.uniform(0.5, 2, size=(300, 1))
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict[int, list[int]] = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    hits = sum(len(set(_exact(rows, q, 5)) & set(found)) for q, found in got.items())
    assert len(got) == 15 and hits >= 0.9 * 75


@pytest.mark.parametrize("lengths", ["outlier", "log-normal", "one direction"])
def test_recall_and_whole_lists_for_any_lengths(spark, lengths):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(400, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if lengths == "outlier":
        vectors[0] *= 100
    elif lengths == "log-normal":
        vectors *= np.exp(0.5 * draw.normal(size=(400, 1)))
    else:  # a query far from all others meets few candidates
        vectors[:, 0] += 6
        vectors[0] *= -1
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict[int, list[int]] = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert set(got) == set(range(0, 400, 20)) and all(len(found) == 20 for found in got.values())
    hits = sum(len(set(_exact(rows, q, 20)) & set(found)) for q, found in got.items())
    assert hits >= 0.9 * 20 * len(got)


def test_fewer_candidates_than_wanted_are_all_returned(spark):
    rows = [(i, [float(i % 3 - 1), float(i % 5 - 2), 1.0, 0.0], 0) for i in range(12)]
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=20).collect()
    assert sorted(r["id"] for r in found) == list(range(1, 12))


def test_copies_ties_and_rows_that_take_no_part(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, one, 0) for i in range(40)] + [
        (100, two, 0),
        (101, None, 0),
        (102, [0.0] * 4, 0),
        (103, [1.0, None, 0.0, 0.0], 0),
        (104, [float("nan"), 0.0, 0.0, 1.0], 0),
        (105, [float("inf"), 0.0, 0.0, 1.0], 0),
        (106, [1.0, 2.0], 0),
        (None, one, 0),
        (7, one, 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict[int, list] = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == {0, 20, 100}
    assert [i for _, i, _ in got[0]] == list(range(1, 21))
    assert [i for _, i, _ in got[20]] == list(range(20))
    assert all(s == 1.0 for _, _, s in got[0])
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
