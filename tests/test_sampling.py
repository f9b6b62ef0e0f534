from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions import sizes
from smudgelab.functions.hashing import digest
from smudgelab.operators import ranking, sampling


def keys(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def order(seed, purpose, ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{purpose}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 7, 250, 999, 1000])
def test_exact_sample_size_and_members(spark, n):
    df = spark.range(1000)
    picked = keys(sampling.exact_sample(df, "id", 3, n))
    assert picked == sorted(order(3, "row", range(1000))[:n])


def test_sample_does_not_depend_on_partitioning(spark):
    one = keys(sampling.percent_sample(spark.range(0, 500, 1, 1), "id", 9, 12.5))
    many = keys(sampling.percent_sample(spark.range(0, 500, 1, 13).repartition(7), "id", 9, 12.5))
    assert one == many and len(one) == 62


def test_cut_descends_into_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LEVEL_DIGITS", 1)
    monkeypatch.setattr(ranking, "SMALL_BUCKET", 3)
    cuts = ranking.DigestCuts(spark.range(400), digest(1, "row", "id"))
    df = spark.range(400)
    for n in (0, 1, 33, 200, 399, 400):
        assert df.where(digest(1, "row", "id") <= cuts.cut(n)).count() == n
    with pytest.raises(ValueError):
        cuts.cut(401)


def test_smaller_share_is_inside_larger(spark):
    df = spark.range(300)
    small, large = (set(keys(sampling.percent_sample(df, "id", 5, p))) for p in (10, 40))
    assert small < large and (len(small), len(large)) == (30, 120)


def test_at_least_one_row(spark):
    assert sampling.percent_sample(spark.range(5), "id", 1, 1).count() == 1
    assert sizes.sample_size(1, 5) == 1 and sizes.sample_size(20, 14) == 2


def test_split_is_exact_and_complete(spark):
    df = sampling.split_train_test(spark.range(101), "id", 4)
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert counts == {"test": 31, "train": 70}


def test_train_cap_leaves_test_side(spark):
    df = sampling.split_train_test(spark.range(200), "id", 4)
    capped = sampling.cap_train(df, "id", 4, 50)
    counts = {r["split"]: r["count"] for r in capped.groupBy("split").count().collect()}
    assert counts == {"test": 60, "train": 50}
    assert sampling.cap_train(df, "id", 4, 140).count() == 200


def test_class_cap_keeps_whole_classes(spark):
    df = spark.range(260).withColumn("y", F.col("id") % 26)
    capped = sampling.cap_classes(df, "y", 8, 10)
    assert capped.select("y").distinct().count() == 10 and capped.count() == 100
    assert sampling.cap_classes(df, "y", 8, 26) is df


def test_feature_cap(spark):
    dataset = S.DatasetSpec("d", "k", "y", tuple(f"n{i}" for i in range(600)), ("c",))
    capped = sampling.cap_features(dataset, 2)
    assert len(capped.features) == 500
    assert capped == sampling.cap_features(dataset, 2) != sampling.cap_features(dataset, 3)


def test_prepare_needs_seed(spark):
    dataset = S.DatasetSpec("d", "id", "y", ("n",), ())
    df = spark.range(10).withColumns({"n": F.col("id"), "y": F.col("id") % 2})
    with pytest.raises(ValueError):
        sampling.prepare(df, dataset, None)


def test_folds_cover_all_rows_once(spark):
    folded = sampling.assign_folds(spark.range(1000), "id", 1, 10)
    counts = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert sum(counts) == 1000 and len(counts) == 10 and min(counts) > 60


def test_batches_follow_the_limit(spark):
    batched = sampling.assign_batches(spark.range(25), "id", 1, 10)
    assert sorted(r["count"] for r in batched.groupBy("batch").count().collect()) == [5, 10, 10]


@pytest.mark.parametrize(
    ("rows", "features", "classes", "limit"),
    [(100, 5, 2, 10000), (9000, 5, 2, 8000), (9000, 450, 2, 6400), (9000, 450, 9, 5120)],
)
def test_inference_limit(spark, rows, features, classes, limit):
    got = spark.range(1).select(sizes.inference_limit(F.lit(rows), F.lit(features), F.lit(classes)).alias("l"))
    assert got.first()["l"] == limit


@pytest.mark.parametrize("window_rows", [7, 100, 10**6])
def test_rank_of_one_hot_group(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 1800, "hot").otherwise("cold"))
    df = df.withColumn("d", digest(0, "x", "id"))
    ranked = ranking.digest_rank(df, "d", ["g"])
    got = {g: sorted((r["pos"], r["d"]) for r in ranked.where(F.col("g") == g).collect()) for g in ("hot", "cold")}
    for rows in got.values():
        assert [p for p, _ in rows] == list(range(len(rows)))
        assert [d for _, d in rows] == sorted(d for _, d in rows)


def test_rank_without_groups(spark, monkeypatch):
    for window_rows in (10, 1000):
        monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
        ranked = ranking.digest_rank(spark.range(60).withColumn("d", digest(0, "x", "id")), "d")
        assert ranked.columns == ["id", "d", "pos"]
        assert [r["pos"] for r in ranked.orderBy("d").collect()] == list(range(60))


@pytest.mark.parametrize("window_rows", [5, 60, 10**6])
def test_running_totals_are_exact(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
    monkeypatch.setattr(ranking, "PIECES", 4)
    df = spark.range(500).select(
        (F.col("id") % 3).alias("g"), F.sin("id").alias("s"), (F.col("id") % 7).alias("v")
    )
    rows = ranking.cumulative_before(df, ["g"], "s", ["v"]).collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["s"]):
            assert r["v_before"] == total
            total += r["v"]


def test_lists_are_stored_in_bounded_parts(spark):
    from smudgelab.functions import text
    from smudgelab.operators import documents

    df = spark.range(95).withColumn("g", F.when(F.col("id") < 80, "hot").otherwise("cold"))
    stored = documents.row_documents(df, ["g"], "id", F.col("g") == "hot", F.col("id") % 2 == 0, rows=10)
    assert {r["g"]: r["n"] for r in stored.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"hot": 8, "cold": 2}
    back = stored.select("g", F.explode(text.test_side_rows(F.col("document"))).alias("id"))
    assert keys(back.where("g = 'hot'")) == list(range(1, 80, 2)) and keys(back.where("g = 'cold'")) == list(range(80, 95))


def test_lists_that_fit_a_part_are_not_ranked(spark):
    from smudgelab.operators import documents

    df = spark.range(40).withColumn("g", F.col("id") % 4)
    stored = documents.row_documents(df, ["g"], "id", F.lit(False), F.lit(False), rows=10)
    assert "Window" not in stored._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["document"] for r in stored.collect()) == sorted(str(list(range(g, 40, 4))).replace(" ", "") for g in range(4))
    assert {r["part"] for r in stored.collect()} == {0}
