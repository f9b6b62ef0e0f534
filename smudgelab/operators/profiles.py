"""Size profiles of datasets and how a suite stands against model limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smudgelab.functions.sizes import share
from smudgelab.spec import MAX_CLASSES, MAX_FEATURES, MAX_TRAIN_ROWS, DatasetSpec


def run_profile(data: DataFrame, dataset: DatasetSpec) -> DataFrame:
    """Train and test size, classes met in training and features of a split table."""
    is_train = F.col("split") == "train"
    return data.agg(
        F.count_if(is_train).alias("train_size"),
        F.count_if(~is_train).alias("test_size"),
        F.countDistinct(F.when(is_train, F.col(dataset.target))).alias("number_of_classes"),
    ).withColumn("number_of_features", F.lit(len(dataset.features)))


def dataset_profiles(df: DataFrame, dataset: Sequence[str], target: str, features: int) -> DataFrame:
    """(dataset.., n_rows, n_classes, n_features) for tables stored one under another.

    Distinct classes come from a two-level count, so a dataset may hold any share
    of the rows.
    """
    by_class = df.groupBy(*dataset, target).agg(F.count("*").alias("n"))
    return by_class.groupBy(*dataset).agg(
        F.sum("n").alias("n_rows"),
        F.count(target).alias("n_classes"),
    ).withColumn("n_features", F.lit(features))


def suite_report(
    profiles: DataFrame,
    suite: Sequence[str] = ("suite", "task"),
    max_rows: int = MAX_TRAIN_ROWS,
    max_features: int = MAX_FEATURES,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Tasks per suite, and how many (and which share) pass each limit.

    Train and test sizes are taken as 70 % and 30 % of the rows. Classes are
    counted for classification suites only.
    """
    over = {
        "samples": F.col("n_rows") > max_rows,
        "train_samples": F.col("n_rows") * 0.7 > max_rows,
        "test_samples": F.col("n_rows") * 0.3 > max_rows,
        "features": F.col("n_features") > max_features,
        "classes": (F.col("task") == "classification") & (F.col("n_classes") > max_classes),
    }
    counted = profiles.groupBy(*suite).agg(
        F.count("*").alias("tasks"), *[F.count_if(c).alias(f"over_{name}") for name, c in over.items()]
    )
    return counted.withColumns(
        {f"share_{name}": share(F.col(f"over_{name}"), F.col("tasks")) for name in over}
    )


def class_list(df: DataFrame, target: str, group: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct classes of each group."""
    return df.groupBy(*group).agg(F.array_sort(F.collect_set(target)).alias("classes"))
