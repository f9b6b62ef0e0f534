from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.operators import encoders, sampling, suite_encoder, synthesis

DATASET = S.DatasetSpec("d", "k", "y", ("n", "m"), ("c",))


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(60).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("n"),
        (F.col("id") % 5).cast("double").alias("m"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))).alias("c"),
        (F.col("id") % 2).alias("y"),
    )
    return sampling.split_train_test(df, "k", 1)


def test_embedding_depends_on_the_train_side(data):
    plain = encoders.embed_test_side(data, DATASET)
    moved = data.withColumn("n", F.when(F.col("split") == "train", F.col("n") * 100).otherwise(F.col("n")))
    other = encoders.embed_test_side(moved, DATASET)
    a, b = ({r["k"]: r["embedding"] for r in df.collect()} for df in (plain, other))
    assert a.keys() == b.keys() and a != b and {len(v) for v in a.values()} == {16}


def test_wide_categories_give_the_same_vectors(data, monkeypatch):
    plain = {r["k"]: r["embedding"] for r in encoders.embed_test_side(data, DATASET).collect()}
    monkeypatch.setattr(encoders, "KNOWN_LITERALS", 1)
    assert {r["k"]: r["embedding"] for r in encoders.embed_test_side(data, DATASET).collect()} == plain


def test_widths_beyond_one_digest(data):
    def fit(train, dataset):
        return encoders.ContextEncoder.fit(train, dataset, width=70)

    assert {len(r["embedding"]) for r in encoders.embed_train_side(data, DATASET, fit).collect()} == {70}


def test_out_of_fold_covers_every_row(data):
    done = suite_encoder.out_of_fold_embeddings(data.drop("split"), DATASET, 3, 3)
    assert done.count() == done.select("k").distinct().count() == 60


@pytest.mark.parametrize("known", [1_000, 1])
def test_out_of_fold_by_subtraction_is_that_of_a_fit_per_fold(data, monkeypatch, known):
    """Nulls, a constant column, values of one fold only, numbers of large offset."""
    monkeypatch.setattr(suite_encoder, "KNOWN_LITERALS", known)
    df = data.drop("split").withColumns(
        {
            "flat": F.lit(0.1),
            "far": F.lit(1e9) + F.col("m"),
            "some": F.when(F.col("k") % 4 == 0, F.col("m")),
            "rare": F.when(F.col("k") % 3 != 0, F.concat(F.lit("r"), (F.col("k") % 29).cast("string"))),
        }
    )
    wide = S.DatasetSpec("wide", "k", DATASET.target, (*DATASET.numeric, "flat", "far", "some"), (*DATASET.categorical, "rare"))
    got = {r["k"]: r for r in suite_encoder.out_of_fold_embeddings(df, wide, 3, 4).collect()}
    want = {r["k"]: r for r in encoders.out_of_fold_by_fits(df, wide, 3, 4).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["fold"] == r["fold"] and got[k]["embedding"] == pytest.approx(r["embedding"], abs=1e-6)


def test_external_model_per_batch(data):
    class Fitted:
        @staticmethod
        def fit(train, dataset):
            centre = train.agg(F.avg("m")).first()[0]
            return encoders.BatchEncoder(dataset, centre, lambda c, pdf: pdf[["m"]].to_numpy() - c)

    got = encoders.embed_test_side(data, DATASET, Fitted.fit)
    train_mean = data.where("split = 'train'").agg(F.avg("m")).first()[0]
    want = {r["k"]: r["m"] - train_mean for r in data.where("split = 'test'").collect()}
    assert {r["k"]: r["embedding"][0] for r in got.collect()} == pytest.approx(want)


def test_synthetic_rows_follow_the_columns(spark):
    draw = np.random.default_rng(2)
    a = draw.normal(size=2000)
    b = 0.8 * a + 0.6 * draw.normal(size=2000)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    made = synthesis.synthesize(df, ["a", "b"], 4).toPandas()
    assert len(made) == 6000
    assert made["a"].mean() == pytest.approx(a.mean(), abs=0.08) and made["a"].std() == pytest.approx(a.std(), abs=0.08)
    assert made["a"].corr(made["b"]) == pytest.approx(0.8, abs=0.05)
    assert made["a"].between(a.min(), a.max()).all()
    tight = synthesis.synthesize(df, ["a", "b"], 4, spread=0.5).toPandas()
    assert tight["a"].std() < 0.7 * made["a"].std()


@pytest.mark.parametrize("used", [None, lambda c: F.col("id") % 2 == int(c == "b")])
def test_projection_spelled_out_is_the_other_form(spark, monkeypatch, used):
    df = spark.range(40).withColumns({"a": F.sin("id"), "b": F.cos("id"), "t": F.when(F.col("id") % 3 > 0, F.col("id") % 5).cast("string")})
    known = F.coalesce(F.col("t") != "2", F.lit(False))
    found = []
    for terms in (256, 0):
        monkeypatch.setattr(encoders, "SPELLED_TERMS", terms)
        vector = encoders.projected({"a": F.col("a"), "b": F.col("b")}, {"t": (F.col("t"), known)}, 40, 3, used)
        found.append([r[0] for r in df.select(vector).collect()])
        assert ("lambda" in df.select(vector)._jdf.queryExecution().toString()) == (terms == 0)
    assert found[0] == found[1]
