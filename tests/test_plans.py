"""Stored runs: resume, evaluation, reports, views."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.operators import sampling, subsets
from smudgelab.plans import evaluate, grid, models, report, sweep, views
from smudgelab.sources import checks, schemas, tables

DATASET = S.DatasetSpec("toy", "k", "y", ("n", "m"), ("c",))
SETTINGS = grid.configurations(types=(S.MCAR, S.SCAR, S.CSCAR), row_percents=(20, 40), column_percents=(100,))


def toy(spark):
    return spark.range(150).select(
        F.col("id").alias("k"),
        (F.sin("id") * 10).alias("n"),
        (F.col("id") % 9).cast("double").alias("m"),
        F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("c"),
        (F.col("id") % 2).alias("y"),
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("runs"))
    new = sweep.run_sweep(spark, toy(spark), DATASET, folder, seeds=(11,), settings=SETTINGS)
    assert new == len(SETTINGS) == 13
    return folder


def read(spark, folder, *names):
    return [tables.read_table(spark, folder, n) for n in names]


def test_default_grid_has_19_settings():
    assert len(grid.configurations()) == 19
    assert grid.valid_percents(S.NONE, [10]) == [0] and grid.valid_percents(S.MCAR, [0, 10, 100, 101]) == [10, 100]
    assert grid.valid_types(S.CLEAN_CLEAN, [S.MCAR]) == [S.NONE]
    assert grid.valid_types(S.DIRTY_CLEAN, [S.MCAR, S.NONE, "X"]) == [S.MCAR]


def test_second_run_does_nothing(spark, stored):
    assert sweep.run_sweep(spark, toy(spark), DATASET, stored, seeds=(11,), settings=SETTINGS) == 0


def test_interrupted_run_is_completed_once(spark, stored, tmp_path):
    folder = str(tmp_path)
    sweep.run_sweep(spark, toy(spark), DATASET, folder, seeds=(11,), settings=SETTINGS[:3])
    vectors, = read(spark, folder, "embeddings")
    # as if a later setting had stopped after its vectors were written
    later, = read(spark, stored, "embeddings")
    fifth = read(spark, stored, "embeddings_experiments")[0].where("tag = 'DIRTY_DIRTY' AND error_type = 'MCAR'").first()
    tables.append(later.where(F.col("experiment_id") == fifth["experiment_id"]), folder, "embeddings")
    assert sweep.run_sweep(spark, toy(spark), DATASET, folder, seeds=(11,), settings=SETTINGS) == 10
    vectors, runs = read(spark, folder, "embeddings", "embeddings_experiments")
    assert checks.duplicate_keys(vectors, ["experiment_id", "row_id"]).isEmpty()
    assert runs.count() == 13 and vectors.count() == 13 * 45


def test_stored_tables_keep_their_rules(spark, stored):
    for name in ("embeddings_experiments", "embeddings", "corrupted_rows", "corrupted_columns"):
        df, = read(spark, stored, name)
        rules = schemas.TABLES[name]
        assert checks.duplicate_keys(df, rules.primary_key).isEmpty()
        for column, parent in rules.references:
            assert checks.orphans(df, column, read(spark, stored, parent)[0], column).isEmpty()
        needed = [f.name for f in rules.schema.fields if not f.nullable]
        assert all(r["nulls"] == 0 for r in checks.null_counts(df, needed).collect())


def test_positions_count_from_zero(spark, stored):
    vectors, = read(spark, stored, "embeddings")
    for r in vectors.groupBy("experiment_id").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect():
        assert r["p"] == list(range(45))


def test_evaluation_is_complete_and_resumable(spark, stored):
    added = evaluate.run_evaluation(spark, stored)
    assert added > 0 and evaluate.run_evaluation(spark, stored) == 0
    found, runs = read(spark, stored, "embedding_evaluation_metrics", "embeddings_experiments")
    assert checks.duplicate_keys(found, ["evaluation_id"]).isEmpty()
    assert found.select("experiment_id").distinct().count() == runs.count()
    joined = report.joined_metrics(runs, found)
    kinds = {
        (r["tag"], r["evaluation_type"])
        for r in joined.select("tag", "evaluation_type").distinct().collect()
    }
    probes = {"LP_ALL_TLGT", "LP_COR_TLGT", "LP_CLE_TLGT", "LP_ALL_CCGT"}
    distances = {"DFR_ALL", "DFR_COR", "DFR_CLE"}
    assert {t for g, t in kinds if g == S.CLEAN_CLEAN} == probes
    assert {t for g, t in kinds if g == S.DIRTY_DIRTY} == probes | distances
    rates = {r[0] for r in joined.where("tag = 'CLEAN_CLEAN'").select("row_corruption_percent").distinct().collect()}
    assert rates == {0, 10, 20, 40}
    clean = joined.where("tag = 'CLEAN_DIRTY' AND evaluation_type = 'DFR_CLE'").select("metric_value")
    assert all(abs(r[0]) < 1e-9 for r in clean.collect())
    hit = joined.where("tag = 'CLEAN_DIRTY' AND evaluation_type = 'DFR_COR' AND metric_name = 'ZED'")
    assert all(r["metric_value"] > 0 for r in hit.collect())


def test_older_evaluation(spark, stored):
    found = evaluate.evaluate_older(*read(spark, stored, "embeddings_experiments", "embeddings", "corrupted_rows"))
    rows = found.collect()
    assert {"linear probing fit to all", "linear probing unaffected-corrupted", "linear probing corrupted-unaffected",
            "clustering all test", "clustering unaffected", "clustering corrupted", "knn similarity"} == {
        r["evaluation_type"] for r in rows}
    assert all(r["other_info"] for r in rows if r["evaluation_type"].startswith(("linear", "clustering")))
    assert all(0 < r["metric_value"] <= 1 for r in rows if r["metric_name"] == "Purity")


def test_inconsistent_runs_are_rejected_with_a_reason(spark, stored):
    runs, vectors = read(spark, stored, "embeddings_experiments", "embeddings")
    some = [r["experiment_id"] for r in runs.orderBy("experiment_id").limit(3).collect()]
    bad = runs.withColumn("number_of_classes", F.when(F.col("experiment_id") == some[0], 1).otherwise(F.col("number_of_classes")))
    bad = bad.withColumn("test_size", F.when(F.col("experiment_id") == some[1], 46).otherwise(F.col("test_size")))
    _, rejected = evaluate.usable(bad, vectors.where(F.col("experiment_id") != some[2]))
    reasons = {r["experiment_id"]: r["reason"] for r in rejected.collect()}
    assert reasons == {some[0]: "single class", some[1]: "fewer embeddings than labels", some[2]: "no embeddings"}


def test_surplus_vectors_are_cut(spark, stored):
    runs, vectors = read(spark, stored, "embeddings_experiments", "embeddings")
    doubled = vectors.unionByName(vectors.withColumn("pos", F.col("pos") + 45))
    assert subsets.keep_first(doubled, runs, ["experiment_id"], "test_size").count() == vectors.count()


def test_view_has_all_panels(spark, stored):
    runs, vectors, manifest = read(spark, stored, "embeddings_experiments", "embeddings", "corrupted_rows")
    chosen = runs.where("tag = 'DIRTY_DIRTY' AND error_type = 'SCAR' AND row_corruption_percent = 40").first()[0]
    prepared = sampling.prepare(toy(spark), DATASET, 11)
    raw = views.raw_vectors(prepared.data.where("split = 'test'"), DATASET)
    flat = views.planar_view(chosen, runs, vectors, manifest, raw, {"CLEAN": "FLIP_VER", "RAW": "FLIP_BOTH"}).toPandas()
    assert flat.groupby("panel").size().to_dict() == {"CLEAN": 45, "COR_20": 45, "COR_40": 45, "RAW": 45}
    assert flat.loc[flat.panel == "CLEAN", "y"].min() == 0 and flat.loc[flat.panel == "RAW", "x"].min() == 0
    assert flat.loc[flat.panel == "RAW", "is_corrupted"].sum() == 18 and set(flat.label_code) == {0, 1}


def test_view_reads_the_embeddings_of_its_runs_only(spark, stored, tmp_path):
    runs, vectors, manifest = read(spark, stored, "embeddings_experiments", "embeddings", "corrupted_rows")
    chosen = runs.where("tag = 'DIRTY_DIRTY' AND error_type = 'SCAR' AND row_corruption_percent = 40").first()[0]
    flat = views.planar_view(chosen, runs, vectors, manifest)
    assert not any("/embeddings/" in f for f in flat.inputFiles())


def test_stored_lists_are_not_broadcast(spark, stored):
    runs, vectors, manifest = read(spark, stored, "embeddings_experiments", "embeddings", "corrupted_rows")
    keys = ["experiment_id", "row_id"]
    links, _ = subsets.clean_reference(runs)
    for joined in (
        subsets.flag_corrupted(vectors, manifest, keys),
        subsets.clean_rows(vectors, manifest, keys),
        subsets.missing_from_test(manifest, vectors, keys),
    ):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    paired = subsets.pair_by_position(vectors, vectors, links)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in paired


def test_rows_for_many_passes_are_dealt_out(spark):
    one = spark.range(1000).coalesce(1)
    tasks = models.dealt(one).rdd.getNumPartitions()
    assert tasks == spark.sparkContext.defaultParallelism > 1


def metric_rows(spark, rows):
    return spark.createDataFrame(
        rows, "experiment_id string, evaluation_type string, metric_name string, metric_value double, row_corruption_percent int"
    )


def test_nan_is_dropped_from_lines_and_kept_in_baselines(spark):
    runs = spark.createDataFrame(
        [("e", S.CLEAN_CLEAN, S.NONE, 10, 5), ("f", S.DIRTY_DIRTY, S.MCAR, 10, 5)],
        "experiment_id string, tag string, error_type string, train_size int, test_size int",
    )
    rows = metric_rows(spark, [(e, "DFR_ALL", "ZED", v, 10) for e in "ef" for v in (1.0, 3.0, math.nan)])
    joined = report.joined_metrics(runs, rows)
    assert {r["value"] for r in report.average_by_type_and_rate(joined).collect()} == {2.0}
    assert math.isnan(report.baseline(joined).first()["baseline"])


def test_context_sizes_share_their_bound(spark):
    runs = spark.createDataFrame(
        [("e", S.CLEAN_DIRTY, S.MCAR, 5000, 5)],
        "experiment_id string, tag string, error_type string, train_size int, test_size int",
    )
    rows = metric_rows(spark, [("e", "LP_ALL_TLGT", "ROC_AUC", 0.5, 10)])
    assert {r["context"] for r in report.context_size_report(runs, rows).collect()} == {"few", "many"}


def test_series_are_in_rate_order(spark):
    df = spark.createDataFrame([("a", "MCAR", r, r / 10) for r in (40, 10, 20)], "p string, error_type string, rate int, value double")
    got = report.series(df, ["p"]).first()
    assert got["rates"] == [10, 20, 40] and got["values"] == [1.0, 2.0, 4.0]


def test_conform_requires_key_columns(spark):
    with pytest.raises(ValueError):
        schemas.conform(spark.range(1), schemas.METRICS)


def test_classification_run_is_stored(spark, tmp_path):
    prepared = sampling.prepare(toy(spark), DATASET, 5)
    row = models.classification_run(prepared, 5, S.CLEAN_DIRTY, S.CorruptionSpec(S.MCAR, 5, 20, 50), str(tmp_path)).first()
    assert row["train_size"] == 105 and row["test_size"] == 45 and 0 <= row["roc_auc"] <= 1
    kept, = read(spark, str(tmp_path), "classification_experiments")
    assert kept.first()["experiment_id"] == row["experiment_id"]


def test_search_finds_a_signal(spark):
    dataset = S.DatasetSpec("toy", "k", "y", ("n",), ("c",))
    df = toy(spark).withColumn("y", (F.col("n") > 0).cast("int"))
    prepared = sampling.prepare(df, dataset, 5)
    assert models.baseline_report(spark, prepared.data, dataset, 5, alphas=(0.001,), folds=2).first()["roc_auc"] > 0.9


def test_named_datasets_and_csv_source(spark, tmp_path):
    assert tables.named_datasets(spark).count() == 12
    toy(spark).write.csv(str(tmp_path / "toy"), header=True)
    loaded = tables.load_labelled(spark, str(tmp_path / "toy"), DATASET, "csv", header="true", inferSchema="true")
    assert loaded.columns == ["k", "n", "m", "c", "y"] and loaded.count() == 150
    features, target = tables.features_and_target(loaded, "y")
    assert target.columns == ["y"] and "y" not in features.columns
