"""Models and metrics that a user plugs in, and the classification sweep."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions.sizes import batch_rows
from smudgelab.operators import encoders, sampling
from smudgelab.plans import classification, evaluate, grid, models, suite
from smudgelab.sources import checks, schemas, tables

# The models below go to Python workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DATASET = S.DatasetSpec("toy", "k", "y", ("n", "m"), ("c",))
SETTINGS = grid.configurations(row_percents=(20, 40), column_percents=(50,))


def toy(spark, rows=200, classes=2):
    k = F.col("id")
    return spark.range(rows).select(
        k.alias("k"),
        (F.sin("id") * 10 + (k % classes) * 8).alias("n"),
        (k % 9).cast("double").alias("m"),
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("c"),
        (k % classes).alias("y"),
    )


# ---------------------------------------------------------------- batches of bounded size


@pytest.mark.parametrize("limit", [1, 7, 10, 64, 1000])
def test_batches_keep_rows_in_order_and_the_limit(limit):
    sizes = [3, 0, 25, 10, 1, 40]
    frames, start = [], 0
    for n in sizes:
        frames.append(pd.DataFrame({"i": range(start, start + n)}))
        start += n
    cut = list(encoders.cut_batches(iter(frames), limit))
    assert [i for b in cut for i in b["i"]] == list(range(79))
    assert all(len(b) == limit for b in cut[:-1]) and 0 < len(cut[-1]) <= limit


def nearest_mean(rows, y):
    """A tiny model: class means of the numeric columns; records the batches it sees."""
    means = rows[["n", "m"]].astype(float).fillna(0).groupby(y.to_numpy()).mean()
    return means.to_numpy()


def closeness(state, rows):
    assert len(rows) <= 8  # never more than the limit
    x = rows[["n", "m"]].astype(float).fillna(0).to_numpy()
    d = ((x[:, None, :] - state[None]) ** 2).sum(axis=2)
    p = np.exp(-d / 50)
    return p / p.sum(axis=1, keepdims=True)


def plugged(train, dataset):
    found = encoders.batch_predictor(train, dataset, nearest_mean, closeness)
    return encoders.BatchPredictor(dataset, found.classes, found.state, closeness, limit=8)


def test_predictor_never_sees_more_than_its_limit(spark):
    prepared = sampling.prepare(toy(spark).repartition(2), DATASET, 5)
    scored, classes = models.class_probabilities(prepared.data, DATASET, plugged)
    rows = scored.collect()
    assert classes == ["0", "1"] and len(rows) == 60
    assert all(sum(r["probabilities"]) == pytest.approx(1) for r in rows)
    run = models.classification_run(prepared, 5, S.CLEAN_DIRTY, S.CorruptionSpec(S.MCAR, 5, 20, 50), fit=plugged).first()
    assert run["test_size"] == 60 and run["roc_auc"] > 0.5


def test_batch_limit_follows_the_train_side(spark):
    found = encoders.batch_predictor(toy(spark, classes=9), DATASET, nearest_mean, closeness)
    assert found.limit == batch_rows(200, 3, 9) == 8000
    assert [batch_rows(*x) for x in ((100, 5, 2), (9000, 5, 2), (9000, 450, 2), (9000, 450, 9))] == [10000, 8000, 6400, 5120]
    with pytest.raises(ValueError, match="at most 100 train rows"):
        encoders.batch_predictor(toy(spark), DATASET, nearest_mean, closeness, most_rows=100)


def test_encoder_batches_and_a_model_that_loses_rows(spark):
    def embed(state, rows):
        assert len(rows) <= 5
        return rows[["m"]].to_numpy() - state

    encoder = encoders.BatchEncoder(DATASET, 1.0, embed, limit=5)
    got = {r["k"]: r["embedding"] for r in encoder.transform(toy(spark, 33).coalesce(1)).collect()}
    assert got == {k: [k % 9 - 1.0] for k in range(33)}
    broken = encoders.BatchEncoder(DATASET, None, lambda s, rows: np.zeros((1, 2)), limit=50)
    with pytest.raises(Exception, match="returned 1 rows"):
        broken.transform(toy(spark, 33)).collect()


# ---------------------------------------------------------------- classification sweep


def auc(hit, p):
    up, down = p[hit][:, None], p[~hit][None, :]
    return float(((up > down) + 0.5 * (up == down)).mean())


def stored(spark, folder):
    return tables.read_table(spark, folder, classification.TABLE)


def test_sweep_is_resumable_and_has_every_meaningful_run(spark, tmp_path):
    folder = str(tmp_path)
    suite_tables = [(toy(spark), DATASET), (toy(spark, 150, 3).withColumnRenamed("c", "d"), S.DatasetSpec("three", "k", "y", ("n", "m"), ("d",)))]
    first = classification.run_classification(spark, suite_tables[:1], folder, (4,), SETTINGS[:5])
    assert first == 5
    rest = classification.run_classification(spark, suite_tables, folder, (4, 5), SETTINGS)
    assert classification.run_classification(spark, suite_tables, folder, (4, 5), SETTINGS) == 0
    rows = stored(spark, folder)
    empty = tables.read_table(spark, folder, "empty_settings")
    assert rows.count() == first + rest == 2 * 2 * len(SETTINGS) - empty.count()
    assert checks.duplicate_keys(rows, schemas.TABLES[classification.TABLE].primary_key).isEmpty()
    for r in rows.collect():
        assert all(0 <= r[c] <= 1 for c in ("roc_auc", "accuracy", "recall", "precision", "f1_score"))
    clean = rows.where("tag = 'CLEAN_CLEAN'").collect()
    assert len(clean) == 4 and all(r["roc_auc"] > 0.6 for r in clean)
    named = classification.described(spark, rows, ["toy", "three"], (4, 5), SETTINGS)
    assert named.where("error_type IS NULL").isEmpty()


def test_scores_are_those_of_the_predictions(spark):
    draw = np.random.default_rng(2)
    rows, want = [], {}
    for e, k in (("two", 2), ("three", 3)):
        p = draw.dirichlet(np.ones(k), 40).round(2)
        y = draw.integers(0, k, 40)
        names = list("abc"[:k])
        rows += [(e, names[y[i]], p[i].tolist(), names) for i in range(40)]
        predicted = p.argmax(axis=1)
        if k == 2:
            tp = ((predicted == 1) & (y == 1)).sum()
            want[e] = (auc(y == 1, p[:, 1]), (predicted == y).mean(), tp / (y == 1).sum(), tp / (predicted == 1).sum())
        else:
            a = (predicted == y).mean()
            want[e] = (np.mean([auc(y == c, p[:, c]) for c in range(3)]), a, a, a)
    df = spark.createDataFrame(rows, "experiment_id string, label string, p array<double>, names array<string>")
    for r in classification._scores(df).collect():
        got = (r["roc_auc"], r["accuracy"], r["recall"], r["precision"])
        assert got == pytest.approx(want[r["experiment_id"]])


def test_own_model_setting_by_setting(spark, tmp_path):
    folder = str(tmp_path)
    some = SETTINGS[:3]
    assert classification.run_classification(spark, [(toy(spark), DATASET)], folder, (4,), some, fit=plugged) == 3
    assert classification.run_classification(spark, [(toy(spark), DATASET)], folder, (4,), some, fit=plugged) == 0
    assert stored(spark, folder).count() == 3


def test_one_class_gives_no_row(spark, tmp_path):
    flat = toy(spark).withColumn("y", F.lit(1))
    assert classification.run_classification(spark, [(flat, DATASET)], str(tmp_path), (4,), SETTINGS[:2]) == 0


# ---------------------------------------------------------------- metrics


def test_new_metric_is_computed_alone(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    suite.run_suite(spark, [(toy(spark), DATASET)], folder, (4,), SETTINGS[:4])
    added = evaluate.run_evaluation(spark, folder)
    assert added > 0 and evaluate.run_evaluation(spark, folder) == 0
    monkeypatch.setattr(evaluate, "METRIC_REGISTRY", dict(evaluate.METRIC_REGISTRY))
    seen = []

    def rows_per_run(context):
        seen.append({r["experiment_id"] for r in context.open.collect()})
        return context.rows.groupBy("experiment_id", "row_corruption_percent").agg(
            F.count("*").cast("double").alias("metric_value")
        ).select(
            "*", F.lit("SIZE").alias("evaluation_type"), F.lit("ROWS").alias("metric_name"), F.lit(None).cast("string").alias("other_info")
        )

    evaluate.register_metric("rows", rows_per_run)
    monkeypatch.setitem(evaluate.METRIC_REGISTRY, "probes", evaluate.Metric(lambda c: pytest.fail("computed again")))
    assert evaluate.run_evaluation(spark, folder) == 7  # three runs once, the clean one at four percents
    found = tables.read_table(spark, folder, "embedding_evaluation_metrics")
    assert found.where("evaluation_type = 'SIZE' AND metric_value = 60").count() == 7
    assert len(seen[0]) == 4
    assert evaluate.run_evaluation(spark, folder) == 0
    # a run that is added later is evaluated by all metrics, and it alone
    monkeypatch.undo()
    monkeypatch.setattr(evaluate, "METRIC_REGISTRY", {**evaluate.METRIC_REGISTRY, "rows": evaluate.Metric(rows_per_run)})
    suite.run_suite(spark, [(toy(spark), DATASET)], folder, (4,), SETTINGS[:5])
    assert evaluate.run_evaluation(spark, folder) > 1 and len(seen[-1]) == 1
    ledger = tables.read_table(spark, folder, "evaluation_ledger")
    assert checks.duplicate_keys(ledger, ["experiment_id", "metric"]).isEmpty() and ledger.count() == 5 * 3


def test_interrupted_evaluation_adds_nothing_twice(spark, tmp_path):
    folder, other = str(tmp_path / "a"), str(tmp_path / "b")
    for f in (folder, other):
        suite.run_suite(spark, [(toy(spark), DATASET)], f, (4,), SETTINGS[:3])
    evaluate.run_evaluation(spark, other)
    whole = tables.read_table(spark, other, "embedding_evaluation_metrics")
    # as if it had stopped before the ledger was written
    tables.append(whole.limit(5), folder, "embedding_evaluation_metrics")
    assert evaluate.run_evaluation(spark, folder) == whole.count() - 5
    found = tables.read_table(spark, folder, "embedding_evaluation_metrics")
    assert checks.duplicate_keys(found, ["evaluation_id"]).isEmpty() and found.count() == whole.count()


def test_areas_of_a_sweep_come_from_packed_scores(spark, tmp_path, monkeypatch):
    kinds, ranked = [], classification.roc_auc

    def watched(df, group, label, score):
        kinds.append((df.schema[label].dataType.simpleString(), df.schema[score].dataType.simpleString()))
        return ranked(df, group, label, score)

    monkeypatch.setattr(classification, "roc_auc", watched)
    assert classification.run_classification(spark, [(toy(spark), DATASET)], str(tmp_path), (4,), SETTINGS[:3]) == 3
    assert kinds == [("binary", "binary")]
