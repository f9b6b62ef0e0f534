"""Row subsets, consistency checks and matching of stored embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions.hashing import digest
from smudgelab.operators.lookup import lookup_join
from smudgelab.operators.ranking import digest_rank


def not_broadcast(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the rows. Stored lists pack so well that Spark takes millions of
    rows for a few megabytes and would send them through the driver."""
    return df.hint("merge")


def flag_corrupted(rows: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``is_corrupted``: the row is in the manifest."""
    listed = manifest.select(*keys).distinct().withColumn("listed", F.lit(True))
    return (
        rows.join(not_broadcast(listed), list(keys), "left")
        .withColumn("is_corrupted", F.coalesce("listed", F.lit(False)))
        .drop("listed")
    )


def with_samples_type(rows: DataFrame, flag: str = "is_corrupted") -> DataFrame:
    """Each row once as ALL and once as COR or CLE."""
    own = F.when(F.col(flag), "COR").otherwise("CLE")
    return rows.withColumn("samples_type", F.explode(F.array(F.lit("ALL"), own)))


def clean_rows(rows: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows less the damaged ones."""
    return rows.join(not_broadcast(manifest.select(*keys)), list(keys), "left_anti")


def test_side(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("side") == "test")


def keep_first(embeddings: DataFrame, limits: DataFrame, on: Sequence[str], limit: str) -> DataFrame:
    """Drops positions at or past the number of labels of an experiment."""
    return lookup_join(embeddings, limits.select(*on, limit), on, "inner").where(F.col("pos") < F.col(limit)).drop(limit)


def check_consistency(experiments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when usable) to each experiment."""
    counts = embeddings.groupBy("experiment_id").agg(F.count("*").alias("n_embeddings"))
    joined = experiments.join(counts, "experiment_id", "left").fillna(0, ["n_embeddings"])
    reason = (
        F.when(F.col("n_embeddings") == 0, "no embeddings")
        .when(F.col("n_embeddings") < F.col("test_size"), "fewer embeddings than labels")
        .when(F.col("number_of_classes") <= 1, "single class")
    )
    return joined.withColumn("reason", reason)


def positions(test_rows: DataFrame, key: str, seed: int | Column, group: Sequence[str] = ()) -> DataFrame:
    """Place of each test row in the shuffled test split, from 0."""
    order = "position__digest"
    return digest_rank(test_rows.withColumn(order, digest(seed, "position", key)), order, group).drop(order)


def missing_from_test(manifest: DataFrame, test_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest rows the test split does not have: the run cannot be repeated."""
    return manifest.join(not_broadcast(test_rows.select(*keys)), list(keys), "left_anti")


def clean_reference(experiments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(experiment_id, clean_experiment_id) for damaged experiments, and those without one.

    The reference is the undamaged run of the same dataset and seed.
    """
    undamaged = (
        (F.col("tag") == S.CLEAN_CLEAN)
        & (F.col("error_type") == S.NONE)
        & (F.col("row_corruption_percent") == 0)
        & (F.col("column_corruption_percent") == 0)
    )
    clean = experiments.where(undamaged).groupBy("dataset_name", "random_seed").agg(
        F.min("experiment_id").alias("clean_experiment_id")
    )
    dirty = experiments.where(F.col("tag") != S.CLEAN_CLEAN)
    matched = dirty.join(clean, ["dataset_name", "random_seed"], "left").select(
        "experiment_id", "dataset_name", "random_seed", "clean_experiment_id"
    )
    return matched.where("clean_experiment_id IS NOT NULL"), matched.where("clean_experiment_id IS NULL")


def borrowed_rows(
    experiments: DataFrame, percents: Sequence[int] = S.CLEAN_CLEAN_PERCENTS
) -> DataFrame:
    """Source of the damaged-row list for each clean-clean run and row percent.

    A clean-clean run has no damaged rows of its own. For every percent above 0 it
    takes those of one clean-dirty run of the same dataset, seed and percent:
    CSCAR last (its list has changed rows only), then by name and id.
    """
    donors = experiments.where(F.col("tag") == S.CLEAN_DIRTY)
    order = F.struct(
        (F.col("error_type") == S.CSCAR).cast("int").alias("late"),
        F.col("error_type"),
        F.col("experiment_id"),
    )
    donor = donors.groupBy("dataset_name", "random_seed", "row_corruption_percent").agg(
        F.min_by("experiment_id", order).alias("source_experiment_id")
    )
    takers = (
        experiments.where(F.col("tag") == S.CLEAN_CLEAN)
        .select("experiment_id", "dataset_name", "random_seed")
        .withColumn("row_corruption_percent", F.explode(F.array(*[F.lit(p) for p in percents])))
        .withColumn(
            "row_corruption_percent",
            F.col("row_corruption_percent").cast(experiments.schema["row_corruption_percent"].dataType),
        )
    )
    return takers.join(donor, ["dataset_name", "random_seed", "row_corruption_percent"], "left")


def first_by(df: DataFrame, group: Sequence[str], *order: Column | str) -> DataFrame:
    """The row of each group that comes first under a total ascending order."""
    picked = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("first")
    return df.groupBy(*group).agg(picked).select("first.*")


def pair_by_position(dirty: DataFrame, clean: DataFrame, links: DataFrame) -> DataFrame:
    """Each damaged-run vector with the clean vector at the same position.

    Positions missing on either side are dropped, as in pairing two lists.
    """
    linked = lookup_join(dirty, links.select("experiment_id", "clean_experiment_id"), ["experiment_id"], "inner")
    reference = clean.select(
        F.col("experiment_id").alias("clean_experiment_id"), "pos", F.col("embedding").alias("reference")
    )
    return linked.join(not_broadcast(reference), ["clean_experiment_id", "pos"])


def attach_labels(embeddings: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return embeddings.join(labels, list(keys))
