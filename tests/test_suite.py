"""The suite sweep does what the sweep setting by setting does, in one plan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions.hashing import digest
from smudgelab.operators import corruption, sampling
from smudgelab.operators.group_cuts import GroupCuts
from smudgelab.operators.ranking import DigestCuts
from smudgelab.plans import classification, grid, suite, sweep
from smudgelab.sources import checks, schemas, tables

TOY = S.DatasetSpec("toy", "k", "y", ("n", "m"), ("c", "w"))
PLAIN = S.DatasetSpec("plain", "k", "c", ("n",), ())
SETTINGS = grid.configurations(row_percents=(20, 40), column_percents=(50,))
SEEDS = (11, 12)
TABLES = ("embeddings_experiments", "embeddings", "corrupted_rows", "corrupted_columns", "empty_settings")


def toy(spark, rows=160):
    k = F.col("id")
    return spark.range(rows).select(
        k.alias("k"),
        F.when(k % 11 != 0, F.sin("id") * 10).alias("n"),
        (k % 9).cast("int").alias("m"),
        F.when(k % 7 != 0, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("c"),
        F.concat(F.lit("w"), (k % 13).cast("string")).alias("w"),
        (k % 3).alias("y"),
    )


def read(spark, folder):
    return {t: tables.read_table(spark, folder, t) for t in TABLES}


def rows_of(df):
    columns = [c for c in df.columns if c != "embedding"]
    return sorted(map(str, df.select(*columns).collect()))


def vectors_of(df):
    return {(r["experiment_id"], r["row_id"]): r["embedding"] for r in df.collect()}


def same(spark, left, right):
    a, b = read(spark, left), read(spark, right)
    for t in TABLES:
        assert rows_of(a[t]) == rows_of(b[t]), t
    vectors = vectors_of(b["embeddings"])
    for key, vector in vectors_of(a["embeddings"]).items():
        assert vector == pytest.approx(vectors[key], abs=1e-9)


@pytest.fixture(scope="module")
def one_by_one(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("one"))
    for df, dataset in ((toy(spark), TOY), (toy(spark, 90), PLAIN)):
        sweep.run_sweep(spark, df, dataset, folder, SEEDS, SETTINGS, max_rows=80)
    return folder


def suite_tables(spark):
    return [(toy(spark).repartition(3), TOY), (toy(spark, 90), PLAIN)]


@pytest.mark.parametrize("domain", [200, 2])
def test_same_as_setting_by_setting(spark, one_by_one, tmp_path, monkeypatch, domain):
    monkeypatch.setattr("smudgelab.operators.suite_damage.LITERAL_DOMAIN", domain)
    monkeypatch.setattr("smudgelab.operators.suite_encoder.KNOWN_LITERALS", domain)
    folder = str(tmp_path)
    added = suite.run_suite(spark, suite_tables(spark), folder, SEEDS, SETTINGS, suite.Caps(max_rows=80))
    assert added == read(spark, folder)["embeddings_experiments"].count()
    same(spark, folder, one_by_one)
    assert suite.run_suite(spark, suite_tables(spark), folder, SEEDS, SETTINGS, suite.Caps(max_rows=80)) == 0


def test_empty_settings_are_stored_once(spark, one_by_one):
    stored = read(spark, one_by_one)["empty_settings"]
    # a table without categories: shifts damage nothing, in either mode, rate and seed
    assert {r["dataset_name"] for r in stored.collect()} == {"plain"}
    assert stored.where("error_type = 'CSCAR'").count() == stored.count() == 2 * 2 * len(SEEDS)
    assert checks.duplicate_keys(stored, schemas.NATURAL_KEY).isEmpty()
    assert sweep.run_sweep(spark, toy(spark, 90), PLAIN, one_by_one, SEEDS, SETTINGS, max_rows=80) == 0
    assert read(spark, one_by_one)["empty_settings"].count() == 2 * 2 * len(SEEDS)


def test_interrupted_suite_is_completed_once(spark, one_by_one, tmp_path):
    folder = str(tmp_path)
    caps = suite.Caps(max_rows=80)
    some = suite.run_suite(spark, suite_tables(spark)[:1], folder, SEEDS[:1], SETTINGS[:5], caps)
    # as if it had stopped after the vectors of more settings were written
    whole = read(spark, one_by_one)
    done = read(spark, folder)["embeddings_experiments"].select("experiment_id")
    later = whole["embeddings"].join(done, "experiment_id", "left_anti")
    tables.append(later.where(F.col("pos") < 7), folder, "embeddings")
    tables.append(whole["corrupted_rows"].join(done, "experiment_id", "left_anti").limit(9), folder, "corrupted_rows")
    rest = suite.run_suite(spark, suite_tables(spark), folder, SEEDS, SETTINGS, caps)
    assert some + rest == whole["embeddings_experiments"].count()
    for t in TABLES[:4]:
        key = schemas.TABLES[t].primary_key
        assert checks.duplicate_keys(read(spark, folder)[t], key).isEmpty()
    same(spark, folder, one_by_one)


def test_caps_by_seed(spark, tmp_path):
    caps = {"max_rows": 70, "max_features": 2, "max_classes": 2}
    one, all_ = str(tmp_path / "one"), str(tmp_path / "all")
    sweep.run_sweep(spark, toy(spark), TOY, one, (1, 2, 3), SETTINGS[:6], **caps)
    suite.run_suite(spark, [(toy(spark), TOY)], all_, (1, 2, 3), SETTINGS[:6], suite.Caps(**caps))
    same(spark, all_, one)


def test_names_must_differ_and_types_be_known(spark, tmp_path):
    with pytest.raises(ValueError, match="different names"):
        suite.run_suite(spark, [(toy(spark), TOY)] * 2, str(tmp_path))
    with pytest.raises(ValueError, match="unknown corruption"):
        suite.run_suite(spark, [(toy(spark), TOY)], str(tmp_path), (1,), [(S.DIRTY_DIRTY, "OTHER", 20, 20)])


def test_group_cuts_agree_with_single_ones(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 5 == 0, "a").otherwise("b"))
    h = digest(3, "x", "id")
    wanted = {("a",): [0, 1, 37, 1000], ("b",): [2, 3999]}
    found = GroupCuts(df, h, ["g"])
    assert found.totals == {("a",): 1000, ("b",): 4000}
    for (name, n), cut in found.cuts(wanted).items():
        rows = df.where(F.col("g") == name[0])
        picked = {r["id"] for r in rows.where(h <= cut).collect()}
        assert len(picked) == n
        assert picked == {r["id"] for r in rows.where(h <= DigestCuts(rows, h).cut(n)).collect()}
    with pytest.raises(ValueError, match="cannot take"):
        found.cuts({("a",): [1001]})
    repeated = GroupCuts(df.withColumn("id", F.col("id") % 3), h, ["g"])
    with pytest.raises(ValueError, match="share their key"):
        repeated.cuts({("a",): [1]})


def test_same_jobs_for_more_settings(spark, tmp_path):
    """Settings and seeds are rows: they add no Spark job."""

    def jobs(name, seeds, settings):
        spark.sparkContext.setJobGroup(name, name)
        suite.run_suite(spark, [(toy(spark), TOY)], str(tmp_path / name), seeds, settings)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few = jobs("few", (5,), [s for s in SETTINGS if s[0] == S.DIRTY_DIRTY][:6])
    many = jobs("many", (5, 6, 7), SETTINGS)
    assert many <= few + 15


def test_damaged_cells_are_those_of_corrupt(spark, tmp_path):
    """Cell by cell, for one seed, side and setting."""
    prepared = sampling.prepare(toy(spark), TOY, 11)

    def keep(df, name):
        return df

    rows = suite.prepare_seeds(toy(spark), TOY, (11,), suite.Caps())
    for kind in S.CORRUPTING_TYPES:
        spec = S.CorruptionSpec(kind, 11, 40, 50)
        expected = corruption.corrupt_by_mode(prepared, S.DIRTY_DIRTY, spec)
        damage = suite.learn_damage(rows, {11: TOY}, [(kind, 40, 50)], keep)
        got = damage.apply(
            rows.withColumns(
                {
                    "error_type": F.lit(kind),
                    "row_corruption_percent": F.lit(40).cast("smallint"),
                    "column_corruption_percent": F.lit(50).cast("smallint"),
                }
            )
        )
        features = [F.col(c).cast("string" if c in TOY.categorical else "double").alias(c) for c in TOY.features]
        assert sorted(map(str, got.select("k", "split", *features).collect())) == sorted(
            map(str, expected.data.select("k", "split", *features).collect())
        )


def test_exploded_rows_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suite, "TASK_ROWS", 100)
    started = suite.OpenSweeps.start(
        spark, [(toy(spark), TOY)], str(tmp_path), SEEDS, SETTINGS, suite.Caps(), suite.fit_groups, "embeddings_experiments"
    )
    sweep_ = started.sweeps[0]
    rows = sweep_.side("test", sweep_.meaningful)
    assert rows.count() == 48 * len(sweep_.meaningful)
    assert rows.rdd.getNumPartitions() >= 48 * len(sweep_.meaningful) // 100


def test_predictions_are_stored_by_number(spark, tmp_path):
    clean = [c for c in SETTINGS if c[0] == S.CLEAN_CLEAN or c[1] == S.NONE][:1]
    classification.run_classification(spark, [(toy(spark), TOY)], str(tmp_path), (11,), clean)
    stored = spark.read.parquet(f"{next(tmp_path.glob('work/*/toy/predictions'))}")
    assert stored.count() == 48
    assert {f.dataType.simpleString() for f in stored.schema} == {"int", "array<double>"}
