"""Reports: average metrics per error type and rate, one grouped query for all panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions.text import joined_name, split_type_and_rate
from smudgelab.operators.lookup import lookup_join

# Panels as (evaluation type, metric name).
PROBE_PANELS = (
    ("LP_CLE_TLGT", "ROC_AUC"),
    ("LP_COR_TLGT", "ROC_AUC"),
    ("LP_ALL_TLGT", "ROC_AUC"),
    ("LP_ALL_CCGT", "ROC_AUC"),
)
DISTANCE_PANELS = (
    ("DFR_CLE", "ZED"),
    ("DFR_COR", "ZED"),
    ("DFR_ALL", "ZED"),
    ("DFR_CLE", "COS"),
    ("DFR_COR", "COS"),
    ("DFR_ALL", "COS"),
)
CONTEXT_PANELS = (("LP_ALL_TLGT", "ROC_AUC"), ("LP_ALL_CCGT", "ROC_AUC"))
IDEAL_PANELS = (
    ("knn similarity", "Avg Cosine Similarity (k=1) (unaffected)"),
    ("knn similarity", "Avg Cosine Similarity (k=3) (unaffected)"),
    ("knn similarity", "Avg Cosine Similarity (k=5) (unaffected)"),
    ("knn similarity", "Avg Cosine Similarity (k=10) (unaffected)"),
    ("linear probing fit to all", "ROC AUC"),
    ("clustering all test", "Purity"),
)
# Both bounds are inclusive: 5,000 is in both.
CONTEXT_SIZES = (("few", 0, 5_000), ("many", 5_000, 10_000))

PANEL = ["evaluation_type", "metric_name"]


def size_bounds(
    train_size_max: int | None = None,
    train_size_min: int | None = None,
    test_size_max: int | None = None,
    test_size_min: int | None = None,
) -> Column:
    """Inclusive bounds on the sizes; 0 or nothing is no bound."""
    bounds = [F.lit(True)]
    if train_size_max:
        bounds.append(F.col("train_size") <= train_size_max)
    if train_size_min:
        bounds.append(F.col("train_size") >= train_size_min)
    if test_size_max:
        bounds.append(F.col("test_size") <= test_size_max)
    if test_size_min:
        bounds.append(F.col("test_size") >= test_size_min)
    return reduce(lambda a, b: a & b, bounds)


def in_panels(panels: Sequence[tuple[str, str]]) -> Column:
    """The listed pairs; the plain lists reach the scan and prune its folders."""
    plain = [F.col(c).isin(sorted({p[i] for p in panels})) for i, c in enumerate(PANEL)]
    return plain[0] & plain[1] & F.struct(*PANEL).isin([F.struct(F.lit(a), F.lit(b)) for a, b in panels])


def joined_metrics(experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric rows with the tag, error type and sizes of their experiment.

    The rate is that of the metric row: a clean-clean run has metrics at several.
    """
    facts = experiments.select("experiment_id", "tag", "error_type", "train_size", "test_size")
    return metrics.select("experiment_id", *PANEL, "metric_value", "row_corruption_percent").join(
        facts, "experiment_id"
    )


def average_by_type_and_rate(joined: DataFrame, keys: Sequence[str] = (*PANEL, "tag")) -> DataFrame:
    """(keys.., error_type, rate, value): means over finite values; NaN is dropped."""
    return (
        joined.where(~F.isnan("metric_value"))
        .groupBy(*keys, "error_type", F.col("row_corruption_percent").cast("int").alias("rate"))
        .agg(F.avg("metric_value").alias("value"))
    )


def average_by_composite_name(joined: DataFrame, keys: Sequence[str] = (*PANEL, "tag")) -> DataFrame:
    """The same through a name such as ``MCAR_20``, for tables that keep only that."""
    named = joined.where(~F.isnan("metric_value")).withColumn(
        "type_rate", joined_name(F.col("error_type"), F.col("row_corruption_percent").cast("string"))
    )
    averaged = named.groupBy(*keys, "type_rate").agg(F.avg("metric_value").alias("value"))
    error_type, rate = split_type_and_rate(F.col("type_rate"))
    return averaged.select(*keys, error_type.alias("error_type"), rate.alias("rate"), "value")


def baseline(joined: DataFrame, tag: str = S.CLEAN_CLEAN) -> DataFrame:
    """(evaluation_type, metric_name, baseline): mean over a tag; NaN is kept, as it was stored."""
    return (
        joined.where(F.col("tag") == tag).groupBy(*PANEL).agg(F.avg("metric_value").alias("baseline"))
    )


def series(averages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates and values of each line in rate order."""
    points = F.sort_array(F.collect_list(F.struct("rate", "value")))
    return averages.groupBy(*keys, "error_type").agg(points.alias("points")).select(
        *keys,
        "error_type",
        F.transform("points", lambda p: p["rate"]).alias("rates"),
        F.transform("points", lambda p: p["value"]).alias("values"),
    )


def panel_ranges(averages: DataFrame, margin: float = 0.1) -> DataFrame:
    """Smallest and largest value of a panel, and the range padded on both ends."""
    ends = averages.groupBy(*PANEL).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    pad = (F.col("high") - F.col("low")) * margin
    return ends.withColumns({"padded_low": F.col("low") - pad, "padded_high": F.col("high") + pad})


def _with_baseline(averages: DataFrame, base: DataFrame) -> DataFrame:
    return lookup_join(averages, base, PANEL)


def probe_report(experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Linear probing in three scenarios and four panels, with the clean baseline."""
    joined = joined_metrics(experiments, metrics.where(in_panels(PROBE_PANELS)))
    tags = (S.DIRTY_DIRTY, S.CLEAN_DIRTY, S.CLEAN_CLEAN)
    averages = average_by_type_and_rate(joined.where(F.col("tag").isin(*tags)))
    return _with_baseline(averages, baseline(joined))


def distance_report(experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Perfect context against zero intervention on distances from clean."""
    joined = joined_metrics(experiments, metrics.where(in_panels(DISTANCE_PANELS)))
    return average_by_type_and_rate(joined.where(F.col("tag").isin(S.CLEAN_DIRTY, S.DIRTY_DIRTY)))


def context_size_report(
    experiments: DataFrame, metrics: DataFrame, sizes: Sequence[tuple[str, int, int]] = CONTEXT_SIZES
) -> DataFrame:
    """Small against large clean context; an experiment may be in two sizes."""
    joined = joined_metrics(
        experiments.where(F.col("tag") == S.CLEAN_DIRTY), metrics.where(in_panels(CONTEXT_PANELS))
    )
    member = F.array_compact(
        F.array(
            *[
                F.when(size_bounds(train_size_min=low, train_size_max=high), F.lit(name))
                for name, low, high in sizes
            ]
        )
    )
    sized = joined.withColumn("context", F.explode(member))
    return average_by_type_and_rate(sized, [*PANEL, "context"])


def ideal_report(experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Zero intervention on unaffected rows, with the clean-dirty mean as baseline."""
    joined = joined_metrics(experiments, metrics.where(in_panels(IDEAL_PANELS)))
    averages = average_by_type_and_rate(joined.where(F.col("tag") == S.DIRTY_DIRTY))
    return _with_baseline(averages, baseline(joined, S.CLEAN_DIRTY))
