"""Classification and regression scores per group.

All scores are plain aggregations with map-side combine, so a group may hold any
share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smudgelab.functions.vectors import argmax
from smudgelab.operators.packed_auc import packed_auc
from smudgelab.operators.ranking import cumulative_before


def roc_auc(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve for 0/1 labels, ties counted half.

    Equal scores are merged before anything is ordered. A group with one class
    only gives no row. Labels and scores may come packed as bytes (see ``packed_auc``).
    """
    group = list(group)
    if isinstance(df.schema[score].dataType, T.BinaryType):
        return packed_auc(df, group, label, score)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *group, F.col(score).cast("double").alias("auc_score"), F.col(label).alias("auc_label")
    )
    merged = rows.groupBy(*group, "auc_score").agg(
        F.count_if(F.col("auc_label") == 1).alias("hits"), F.count_if(F.col("auc_label") == 0).alias("misses")
    )
    ordered = cumulative_before(merged, group, "auc_score", ["misses"], size_from=rows)
    won = F.col("hits") * (F.col("misses_before") + F.col("misses") / 2)
    return (
        ordered.groupBy(*group)
        .agg(F.sum(won).alias("won"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
        .where((F.col("hits") > 0) & (F.col("misses") > 0))
        .select(*group, (F.col("won") / (F.col("hits") * F.col("misses"))).alias("roc_auc"))
    )


def roc_auc_one_vs_rest(
    df: DataFrame, group: Sequence[str], label: str, scores: str, classes: Sequence
) -> DataFrame:
    """Unweighted mean over the classes of each class against all others.

    ``scores`` is an array in the order of ``classes``.
    """
    group = list(group)
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), F.col(scores).alias("s"))
    spread = df.select(*group, label, F.explode(pairs).alias("p")).select(
        *group,
        F.col("p.cls").alias("auc_class"),
        F.col("p.s").alias("class_score"),
        (F.col(label) == F.col("p.cls")).cast("int").alias("is_class"),
    )
    each = roc_auc(spread, [*group, "auc_class"], "is_class", "class_score")
    return each.groupBy(*group).agg(F.avg("roc_auc").alias("roc_auc"))


def class_scores(
    df: DataFrame, group: Sequence[str], label: str, predicted: str, positive: Column | None = None
) -> DataFrame:
    """Accuracy, recall, precision and F1.

    With ``positive`` the three last are those of that class; without it they are
    micro averages over all classes. An empty denominator gives 0.
    """
    y, p = F.col(label), F.col(predicted)
    right = F.count_if(y == p)
    if positive is None:
        true_positive, relevant, claimed = right, F.count("*"), F.count("*")
    else:
        true_positive = F.count_if((y == positive) & (p == positive))
        relevant, claimed = F.count_if(y == positive), F.count_if(p == positive)
    counted = df.groupBy(*group).agg(
        F.count("*").alias("n"),
        right.alias("right"),
        true_positive.alias("tp"),
        relevant.alias("relevant"),
        claimed.alias("claimed"),
    )

    def over(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return counted.select(
        *group,
        (F.col("right") / F.col("n")).alias("accuracy"),
        over(F.col("tp"), F.col("relevant")).alias("recall"),
        over(F.col("tp"), F.col("claimed")).alias("precision"),
        over(2 * F.col("tp"), F.col("relevant") + F.col("claimed")).alias("f1_score"),
    )


def regression_scores(df: DataFrame, group: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Mean squared error and coefficient of determination."""
    error = F.pow(F.col(truth) - F.col(predicted), F.lit(2.0))
    return df.groupBy(*group).agg(
        F.avg(error).alias("mse"),
        (1 - F.try_divide(F.avg(error), F.var_pop(truth))).alias("r2"),
    )


def with_prediction(df: DataFrame, scores: str, classes: Sequence, output: str = "prediction") -> DataFrame:
    """The class with the largest score, the first one on ties."""
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(output, F.element_at(names, argmax(F.col(scores)) + 1))
