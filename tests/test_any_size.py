"""Size thresholds steer how a result is found, never the result."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest

from smudgelab import spec as S
from smudgelab.operators import clusters, corruption, lookup, neighbours, planar, probe, ranking, sampling, scores
from smudgelab.operators.ranking import DigestCuts
from pyspark.sql import functions as F


def _rows(df):
    return df.dtypes, sorted(map(str, df.collect()))


@pytest.fixture
def grouped(spark):
    draw = np.random.default_rng(4)
    rows = [
        (i, (None, "a", "b")[i % 3], bool(draw.random() < 0.4), float(draw.normal()), [float(x) for x in draw.normal(size=3)])
        for i in range(90)
    ]
    return spark.createDataFrame(rows, "id long, g string, y boolean, s double, v array<double>")


@pytest.mark.parametrize("most", [5, 10**9])
def test_ranks_and_auc_keep_the_null_group(grouped, monkeypatch, most):
    want = _rows(ranking.digest_rank(grouped.withColumn("d", F.md5(F.col("id").cast("string"))), "d", ["g"]).select("id", "pos"))
    auc = scores.roc_auc(grouped.withColumn("hit", F.col("y").cast("int")), ["g"], "hit", "s")
    want_auc = _rows(auc.select("g", F.round("roc_auc", 9)))
    monkeypatch.setattr(ranking, "WINDOW_ROWS", most)
    got = ranking.digest_rank(grouped.withColumn("d", F.md5(F.col("id").cast("string"))), "d", ["g"]).select("id", "pos")
    assert _rows(got) == want and got.count() == 90
    auc = scores.roc_auc(grouped.withColumn("hit", F.col("y").cast("int")), ["g"], "hit", "s")
    assert _rows(auc.select("g", F.round("roc_auc", 9))) == want_auc and auc.count() == 3


@pytest.mark.parametrize("label", ["boolean", "double", "smallint"])
def test_probe_of_any_label_type(grouped, label):
    df = grouped.withColumn("y", F.col("y").cast("int").cast(label)).withColumn("v", F.col("v"))
    small, large = (
        {r["g"]: round(r["roc_auc"], 6) for r in probe.probe_auc(df, ["g"], "v", "y", local_rows=n).collect()}
        for n in (10**9, 5)
    )
    assert small == large and len(small) == 3


def test_k_means_on_either_path(grouped):
    df = grouped.withColumn("k", F.lit(3))
    small, large = (
        {r["id"]: r["cluster"] for r in clusters.k_means(df, ["g"], "id", "v", "k", local_rows=n).collect()}
        for n in (10**9, 5)
    )
    assert small == large and len(small) == 90
    few = grouped.limit(2).withColumn("k", F.lit(3)).withColumn("g", F.lit("x"))
    assert clusters.k_means(few, ["g"], "id", "v", "k", local_rows=1).count() == 0


@pytest.mark.parametrize("block", [7, 8192])
def test_neighbours_silhouette_and_mirror_keep_the_null_group(grouped, block):
    near = neighbours.nearest_similarities(grouped, ["g"], "id", "v", 3, block_rows=block)
    assert near.count() == 90
    known = grouped.withColumn("c", F.col("id") % 2)
    assert clusters.silhouette(known, ["g"], "id", "v", "c", block_rows=block).count() == 3
    flat = grouped.select("g", F.col("s").alias("x"), F.col("s").alias("y"))
    assert planar.mirror(flat, ["g"], horizontally=True).count() == 90


@pytest.mark.parametrize("kind", ["double", "smallint", "boolean", "date", "string"])
def test_category_shift_on_either_path(spark, monkeypatch, kind):
    cast = F.expr("date_add(date'2020-01-01', cast(c as int))") if kind == "date" else F.col("c").cast(kind)
    df = spark.range(120).withColumn("c", F.col("id") % 9).withColumn("c", cast).withColumn("t", F.col("id") % 2)
    dataset = S.DatasetSpec("d", "id", "t", (), ("c",))
    spec = S.CorruptionSpec(S.CSCAR, 3, 60, 100)
    want = _rows(corruption.corrupt(df, dataset, spec).data)
    monkeypatch.setattr(corruption, "LITERAL_DOMAIN", 1)
    assert _rows(corruption.corrupt(df, dataset, spec).data) == want
    assert dict(want[0])["c"] == kind


def test_scaled_decimals_fit(spark):
    df = spark.createDataFrame([(i, Decimal("99999.99"), i % 2) for i in range(20)], "id long, n decimal(7,2), t long")
    dataset = S.DatasetSpec("d", "id", "t", ("n",), ())
    values = {r["n"] for r in corruption.corrupt(df, dataset, S.CorruptionSpec(S.SCAR, 3, 50, 100)).data.collect()}
    assert len(values) == 2 and max(values) in {Decimal("99999.99") * f for f in (10, 100, 1000)}


def test_cuts_end_or_say_that_keys_repeat(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_BUCKET", 3)
    repeated = spark.range(60).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="share their key"):
        DigestCuts(repeated, F.md5(F.col("k").cast("string"))).cut(10)
    nulls = spark.range(60).select(F.when(F.col("id") < 30, F.col("id")).alias("k"))
    cuts = DigestCuts(nulls, F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))))
    for n in (1, 30, 60):
        try:
            assert nulls.where(F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))) <= cuts.cut(n)).count() == n
        except ValueError as error:
            assert "share their key" in str(error)


def test_caps_only_on_request(spark):
    df = spark.range(200).select("id", (F.col("id") * 1.5).alias("t"), F.lit(1).alias("x"))
    dataset = S.DatasetSpec("d", "id", "t", ("x",), (), "regression")
    assert sampling.prepare(df, dataset, 1, max_classes=3).data.count() == 200
    named = spark.range(200).select("id", F.when(F.col("id") > 20, F.col("id") % 30).alias("t"), F.lit(1).alias("x"))
    assert sampling.prepare(named, S.DatasetSpec("d", "id", "t", ("x",), ()), 1).data.count() == 200
    capped = sampling.cap_classes(named, "t", 1, 10)
    assert capped.where("t is null").count() == 21 and capped.select("t").distinct().count() == 11


@pytest.mark.parametrize("rows", [0, 10**6])
def test_lookups_match_null_with_null(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3), ("a", 2)], "k string, n int")
    right = spark.createDataFrame([(None, "x"), ("a", "y")], "k string, w string")
    want = [("None", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 3, None)]
    for join in (lookup.lookup_join, lambda a, b, on, rows: lookup.join_pinned(a, b, on, rows, "left")):
        got = sorted((str(r["k"]), r["n"], r["w"]) for r in join(left, right, ["k"], rows=rows).collect())
        assert got == want
