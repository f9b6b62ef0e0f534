from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgelab.operators import columns, packed_auc, profiles, scores


def auc(spark, rows):
    df = spark.createDataFrame(rows, "g string, y int, s double")
    return {r["g"]: r["roc_auc"] for r in scores.roc_auc(df, ["g"], "y", "s").collect()}


def test_auc_with_ties(spark):
    assert auc(spark, [("a", 0, 0.1), ("a", 0, 0.5), ("a", 1, 0.5), ("a", 1, 0.9)]) == {"a": 0.875}


def test_auc_needs_both_classes(spark):
    assert auc(spark, [("a", 1, 0.1), ("a", 1, 0.2), ("b", 0, 0.3), ("b", 1, 0.4)]) == {"b": 1.0}


def test_auc_against_pairs_with_a_hot_group(spark):
    draw = np.random.default_rng(0)
    rows = [("hot" if i % 3 else "cold", int(draw.random() < 0.3), float(np.round(draw.random(), 2))) for i in range(900)]
    got, turned = auc(spark, rows), auc(spark, [(g, y, -s) for g, y, s in rows])
    for g in ("hot", "cold"):
        up = [s for h, y, s in rows if h == g and y]
        down = [s for h, y, s in rows if h == g and not y]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
        assert got[g] == pytest.approx(want) and turned[g] == pytest.approx(1 - want)


def by_pairs(rows):
    up = np.array([s for y, s in rows if y == 1])[:, None]
    down = np.array([s for y, s in rows if y == 0])[None, :]
    beaten = (up > down) | (np.isnan(up) & ~np.isnan(down))
    return np.mean(beaten + 0.5 * ((up == down) | (np.isnan(up) & np.isnan(down))))


@pytest.mark.parametrize(("piece", "held"), [(10**6, 10**6), (100, 150), (1, 1)])
def test_auc_of_packed_scores(spark, monkeypatch, piece, held):
    """Groups cut into pieces or not: ties across rows and tasks, NaN, 0 and -0, a null group, other labels, one class."""
    monkeypatch.setattr(packed_auc, "PIECE_SCORES", piece)
    monkeypatch.setattr(packed_auc, "HELD_SCORES", held)
    draw = np.random.default_rng(7)
    blocks, rows = [], {}
    for i in range(24):
        group, n = ("hot", "hot", None, "same", "one", "none")[i % 6], int(draw.integers(1, 200))
        s = np.full(n, 0.3) if group == "same" else np.round(draw.normal(size=n), 1)
        s[draw.random(n) < 0.05] = np.nan if group == "hot" else -0.0
        y = draw.integers(0, 3, n).astype(np.int32) if group != "one" else np.ones(n, np.int32)
        s, y = (s[:0], y[:0]) if group == "none" else (s, y)
        blocks.append((group, i % 2, bytearray(y.tobytes()), bytearray(s.tobytes())))
        rows.setdefault((group, i % 2), []).extend(zip(y, s, strict=True))
    df = spark.createDataFrame(blocks, "g string, k int, y binary, s binary").repartition(5)
    got = {(r["g"], r["k"]): r["roc_auc"] for r in scores.roc_auc(df, ["g", "k"], "y", "s").collect()}
    want = {key: by_pairs(found) for key, found in rows.items() if key[0] not in ("one", "none")}
    assert len(want) == 4 and got == pytest.approx(want, abs=1e-12)


def test_packed_scores_are_those_with_both(spark):
    rows = [(1, 0.5), (0, None), (None, 0.9), (0, 0.2), (1, 0.2)] * 20
    df = spark.createDataFrame(rows, "y int, s double").repartition(3)
    packed = packed_auc.pack_scores(df, "y", "s").withColumn("g", F.lit("a"))
    assert packed.count() <= 3 and scores.roc_auc(packed, ["g"], "hit", "p").first()["roc_auc"] == 0.75
    none = packed_auc.pack_scores(df.limit(0), "y", "s").withColumn("g", F.lit("a"))
    assert scores.roc_auc(none, ["g"], "hit", "p").count() == 0


def test_one_vs_rest_of_two_classes_is_the_binary_auc(spark):
    rows = [(y, [1 - p, p]) for y, p in [(0, 0.2), (1, 0.4), (0, 0.6), (1, 0.9)]]
    df = spark.createDataFrame(rows, "y int, p array<double>").withColumn("g", F.lit(1))
    assert scores.roc_auc_one_vs_rest(df, ["g"], "y", "p", [0, 1]).first()["roc_auc"] == 0.75


def test_class_scores(spark):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)]
    df = spark.createDataFrame(rows, "y int, p int").withColumn("g", F.lit(1))
    r = scores.class_scores(df, ["g"], "y", "p", F.lit(1)).first()
    assert (r["accuracy"], r["recall"], r["precision"], r["f1_score"]) == pytest.approx((0.6, 2 / 3, 2 / 3, 2 / 3))
    r = scores.class_scores(df, ["g"], "y", "p").first()
    assert r["recall"] == r["precision"] == r["f1_score"] == r["accuracy"] == 0.6


def test_scores_of_an_unclaimed_class_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int").withColumn("g", F.lit(1))
    r = scores.class_scores(df, ["g"], "y", "p", F.lit(1)).first()
    assert (r["recall"], r["precision"], r["f1_score"]) == (0, 0, 0)


def test_regression_scores(spark):
    y, p = np.array([1.0, 2, 4]), np.array([1.5, 2, 3])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double").withColumn("g", F.lit(1))
    r = scores.regression_scores(df, ["g"], "y", "p").first()
    assert r["mse"] == pytest.approx(((y - p) ** 2).mean())
    assert r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), ("a", 2), (None, 2)], "c string, n int")
    assert {r["column"]: r["mode"] for r in columns.column_modes(df, ["c", "n"]).collect()} == {"c": "a", "n": "2"}


def test_one_hot_ignores_unknown(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [tuple(r) for r in columns.one_hot(df, "c", ["a", "b"]).collect()] == [(1, 0), (0, 0), (0, 0)]


def test_label_codes_are_sorted(spark):
    df = spark.createDataFrame([("y",), ("n",), ("y",)], "label string")
    assert {r["label"]: r["code"] for r in columns.label_codes(df, "label").collect()} == {"n": 0, "y": 1}


def test_suite_report_counts_classes_for_classification_only(spark):
    profile = spark.createDataFrame(
        [("s", "classification", 20_000, 11, 5), ("s", "classification", 100, 2, 501), ("r", "regression", 15_000, 99, 5)],
        "suite string, task string, n_rows long, n_classes long, n_features int",
    )
    got = {r["suite"]: r for r in profiles.suite_report(profile).collect()}
    assert (got["s"]["over_samples"], got["s"]["over_train_samples"], got["s"]["over_test_samples"]) == (1, 1, 0)
    assert (got["s"]["over_features"], got["s"]["over_classes"], got["s"]["share_classes"]) == (1, 1, 0.5)
    assert got["r"]["over_classes"] == 0 and got["r"]["over_train_samples"] == 1


def test_fitted_stages_zero_unknown_categories(spark):
    from smudgelab.spec import DatasetSpec

    dataset = DatasetSpec("d", "k", "y", ("n",), ("c",))
    train = spark.createDataFrame([(0, 1.0, "a"), (1, None, "b"), (2, 3.0, None)], "k long, n double, c string")
    test = spark.createDataFrame([(3, 2.0, "new")], "k long, n double, c string")
    ready = columns.ready_for_stages(train, dataset)
    model = columns.feature_stages(dataset).fit(ready)
    vector = model.transform(columns.ready_for_stages(test, dataset, train)).first()["features"]
    assert list(vector.toArray()) == pytest.approx([0, 0, 0])
