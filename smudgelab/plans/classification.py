"""Classification sweep over a suite of tables, seeds and settings, resumable.

With the built-in model the whole suite is one plan: train sides are rows of the same frames as in
``suite``, the features are the built-in encoder's vectors (of fixed width, whatever the number of
categories), and logistic regressions of all train sides, one class against the rest, are
fitted together (``newton``). Test rows of all settings are scored in one pass, and every score is
one aggregation by experiment. A model of one's own is fitted setting by setting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions.vectors import argmax
from smudgelab.operators.blocks import vectors_at
from smudgelab.operators.encoders import FitPredictor
from smudgelab.operators.lookup import join_on, join_pinned, lookup_join
from smudgelab.operators.newton import NO_FOLD, Fit, fit_many, pack
from smudgelab.operators.probe import CODE_ROWS, probabilities
from smudgelab.operators.sampling import prepare
from smudgelab.operators.scores import class_scores, roc_auc
from smudgelab.operators.suite_encoder import fit_groups
from smudgelab.plans.grid import configurations, grid
from smudgelab.plans.models import classification_run
from smudgelab.plans.suite import Caps, OpenSetting, OpenSweeps, TableSweep, open_settings
from smudgelab.plans.sweep import JOBS_AT_ONCE
from smudgelab.sources.schemas import CLASSIFICATION, conform
from smudgelab.sources.tables import append, with_experiment_id

TABLE = "classification_experiments"
WIDTH = 32
#: Weight of half the squared coefficients (not the intercept) against the mean loss.
STRENGTH = 0.01
STATE = ["random_seed", "state"]
#: Code of a test label that the train side does not show.
UNKNOWN = -1


def _scored(shared: Broadcast):
    """The code foretold by a row's train side, and the probabilities of the classes that are judged from ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid = batch.column("gid").to_numpy()
            for g in np.unique(gid):
                at = np.flatnonzero(gid == g)
                p = probabilities(vectors_at(batch.column("v"), at), shared.value[g])
                predicted, first = p.argmax(axis=1), int(p.shape[1] == 2)
                p = p[:, first:]
                cuts = pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("run").take(pa.array(at)),
                        batch.column("code").take(pa.array(at)),
                        pa.array(predicted, pa.int32()),
                        pa.array(np.full(len(at), first, dtype=np.int32)),
                        pa.ListArray.from_arrays(cuts, pa.array(p.ravel())),
                    ],
                    ["run", "code", "predicted", "first", "p"],
                )

    return run


def scores_of_table(sweep: TableSweep) -> DataFrame:
    """(experiment_id, roc_auc, accuracy, recall, precision, f1_score) of all settings of a table.

    A train side of one class gives no row. Two classes are judged by the second one; more by micro
    averages and by the mean of one against the rest over the classes that the test side shows.
    """
    spark, dataset = sweep.spark, sweep.damage.dataset
    label = F.col(dataset.target).cast("string").alias("label")
    encoder = replace(sweep.encoder(), width=WIDTH)
    states = {(s.seed, s.on("train")): s for s in sweep.meaningful}
    train = encoder.transform(sweep.side("train", list(states.values())), sweep.used)
    train = train.select(*STATE, label, F.col("embedding").alias("v")).where("label IS NOT NULL")
    classes = train.groupBy(*STATE, "label").agg(F.count("*").alias("n"))
    by_state = Window.partitionBy(*STATE).orderBy("label")
    # A row per train side and class.
    codes = sweep.keep(classes.withColumn("code", F.row_number().over(by_state) - 1), "classes")
    sizes = codes.groupBy(*STATE).agg(F.count("*").alias("classes"), F.sum("n").alias("rows")).where("classes > 1")
    numbered = sizes.orderBy(*STATE).toArrow()  # a row per train side
    if not numbered.num_rows:
        return spark.createDataFrame([], "experiment_id string, roc_auc double, accuracy double, recall double, precision double, f1_score double")
    numbered = numbered.append_column("gid", pa.array(np.arange(numbered.num_rows, dtype=np.int32)))
    sides = spark.createDataFrame(numbered)
    learn = join_pinned(lookup_join(train, sides, STATE, "inner"), codes.drop("n"), [*STATE, "label"], CODE_ROWS)
    packed = pack(learn.select("gid", "v", "code", F.lit(NO_FOLD).alias("fold")))
    fits = []
    for gid, n, rows in zip(numbered["gid"].to_pylist(), numbered["classes"].to_pylist(), numbered["rows"].to_pylist(), strict=True):
        fits += [Fit(gid, t, penalty=STRENGTH * rows, penalise_last=False) for t in ([1] if n == 2 else range(n))]
    weights: dict[int, list[np.ndarray]] = {}
    for fit, own in zip(fits, fit_many(packed, fits, {f.gid: WIDTH + 1 for f in fits}), strict=True):
        weights.setdefault(fit.gid, []).append(own)
    shared = spark.sparkContext.broadcast({g: np.array(w) for g, w in weights.items()})
    # Settings and classes go by number: their names would be most of what is stored and sorted.
    gids = {(r["random_seed"], r["state"]): r["gid"] for r in numbered.to_pylist()}
    judged = [(s, gids.get((s.seed, ":".join(map(str, s.on("train")))))) for s in sweep.meaningful]
    judged = [(i, s.experiment_id, gid) for i, (s, gid) in enumerate(judged) if gid is not None]
    runs = spark.createDataFrame(judged, "run int, experiment_id string, gid int")
    tested = encoder.transform(sweep.side("test", sweep.meaningful), sweep.used)
    tested = tested.select("experiment_id", label, F.col("embedding").alias("v")).where("label IS NOT NULL")
    numbers = join_on(codes, sides, STATE).select("gid", "label", F.col("code").cast("int").alias("code"))
    known = join_pinned(lookup_join(tested, runs, ["experiment_id"], "inner"), numbers, ["gid", "label"], CODE_ROWS, "left")
    coded = known.select("run", "gid", F.coalesce("code", F.lit(UNKNOWN)).alias("code"), "v")
    scored = coded.mapInArrow(_scored(shared), "run int, code int, predicted int, first int, p array<double>")
    found = _scores_by_number(sweep.keep(scored, "predictions"))
    return lookup_join(found, runs.drop("gid"), ["run"], "inner").drop("run")


def _scores(rows: DataFrame) -> DataFrame:
    """From (experiment_id, label, p, names), a label that is not named counts as unknown; see ``scores_of_table``."""
    first = (F.size("p") == 2).cast("int")
    numbered = rows.select(
        F.col("experiment_id").alias("run"),
        F.coalesce((F.array_position("names", F.col("label")) - 1).cast("int"), F.lit(UNKNOWN)).alias("code"),
        argmax(F.col("p")).alias("predicted"),
        first.alias("first"),
        F.slice("p", first + 1, F.size("p")).alias("p"),
    )
    return _scores_by_number(numbered).withColumnRenamed("run", "experiment_id")


def _by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits and scores of each run and judged class, packed."""
    for batch in batches:
        codes, runs = batch.column("code").to_numpy(), batch.column("run").dictionary_encode()
        places, firsts = runs.indices.to_numpy(), batch.column("first").to_numpy()
        order = np.argsort(places, kind="stable")
        found = {"at": [], "target": [], "hit": [], "s": []}
        for at in np.split(order, np.flatnonzero(np.diff(places[order])) + 1) if len(order) else ():
            for target, scores in enumerate(vectors_at(batch.column("p"), at).T, firsts[at[0]]):
                found["at"].append(places[at[0]])
                found["target"].append(target)
                found["hit"].append((codes[at] == target).astype(np.int32).tobytes())
                found["s"].append(scores.tobytes())
        columns = [runs.dictionary.take(pa.array(found.pop("at"), pa.int32()))]
        kinds = (("target", pa.int32()), ("hit", pa.binary()), ("s", pa.binary()))
        yield pa.RecordBatch.from_arrays(columns + [pa.array(found[c], t) for c, t in kinds], ["run", "target", "hit", "s"])


def _scores_by_number(rows: DataFrame) -> DataFrame:
    """From (run, code, predicted, first, p); see ``scores_of_table``. The second of two classes has p alone."""
    schema = f"run {rows.schema['run'].dataType.simpleString()}, target int, hit binary, s binary"
    each = roc_auc(rows.select("run", "code", "first", "p").mapInArrow(_by_target, schema), ["run", "target"], "hit", "s")
    auc = each.groupBy("run").agg(F.avg("roc_auc").alias("roc_auc"))
    two = class_scores(rows.where("first = 1"), ["run"], "code", "predicted", F.lit(1))
    more = class_scores(rows.where("first = 0"), ["run"], "code", "predicted")
    return two.unionByName(more).join(auc, "run", "left")


def run_classification(
    spark: SparkSession,
    tables: Sequence[tuple[DataFrame, S.DatasetSpec]],
    folder: str,
    seeds: Sequence[int] = S.DEFAULT_SEEDS,
    settings: Sequence[tuple[str, str, int, int]] | None = None,
    caps: Caps = Caps(),  # noqa: B008
    fit: FitPredictor | None = None,
) -> int:
    """Scores what is not stored yet of all tables and appends it; returns the new rows.

    ``fit`` plugs in a model of one's own; it is fitted setting by setting, side by side. A setting
    whose train side shows one class only is tried again by the next run.
    """
    if fit is not None:
        return _setting_by_setting(spark, tables, folder, seeds, settings, caps, fit)
    started = OpenSweeps.start(spark, tables, folder, seeds, settings, caps, fit_groups, TABLE)
    parts = []
    for sweep in started.sweeps:
        if sweep.meaningful:
            facts = sweep.experiments().withColumn("used_default_split", F.lit(False))
            parts.append(conform(facts.join(scores_of_table(sweep), "experiment_id"), CLASSIFICATION))
    if not parts:
        return 0
    found = started.sweeps[0].keep(reduce(DataFrame.unionByName, parts), "scores")
    append(found, folder, TABLE)
    return found.count()


def _setting_by_setting(
    spark: SparkSession,
    tables: Sequence[tuple[DataFrame, S.DatasetSpec]],
    folder: str,
    seeds: Sequence[int],
    settings: Sequence[tuple[str, str, int, int]] | None,
    caps: Caps,
    fit: FitPredictor,
) -> int:
    names = [d.name for _, d in tables]
    open_ = open_settings(spark, names, folder, seeds, list(settings or configurations()), TABLE)
    new = 0
    for df, dataset in tables:
        for seed in sorted({s.seed for s in open_[dataset.name]}):
            mine = [s for s in open_[dataset.name] if s.seed == seed]
            prepared = prepare(df, dataset, seed, caps.test_size, caps.max_rows, caps.max_features, caps.max_classes)

            def one(setting: OpenSetting, prepared=prepared, seed=seed) -> DataFrame:
                spec = S.CorruptionSpec(setting.damage[0], seed, *setting.damage[1:])
                return classification_run(prepared, seed, setting.mode, spec, fit=fit)

            with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
                rows = list(pool.map(one, mine))
            append(reduce(DataFrame.unionByName, rows), folder, TABLE)
            new += len(rows)
    return new


def described(spark: SparkSession, stored: DataFrame, names: Sequence[str], seeds: Sequence[int], settings: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """Stored scores with the settings that their ids stand for."""
    suite = spark.createDataFrame([(n,) for n in names], "dataset_name string")
    keys = with_experiment_id(grid(suite, seeds, settings)).drop("dataset_name", "random_seed", "tag")
    return stored.join(keys, "experiment_id", "left")
