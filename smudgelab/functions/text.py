"""Names, composite keys and JSON lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of metric names.
TASKS = {"linear_probing": "LP", "k_means_clustering": "KMC", "distance_from_reference": "DFR"}
SAMPLES = {"corrupted": "COR", "clean": "CLE", "all": "ALL"}
GROUND_TRUTHS = {"task_labels": "TLGT", "clean_corrupted": "CCGT"}
METRICS = {
    "accuracy": "ACC",
    "precision": "PRC",
    "recall": "REC",
    "f1": "F1",
    "roc_auc": "ROC_AUC",
    "purity": "PUR",
    "silhouette": "SIL",
    "cosine": "COS",
    "euclidean": "ED",
    "z_norm_euclidean": "ZED",
}
SCENARIOS = {"perfect_data": "PD", "perfect_context": "PC", "zero_intervention": "ZI"}
SCENARIO_TAGS = {
    "zero_intervention": "DIRTY_DIRTY",
    "perfect_context": "CLEAN_DIRTY",
    "perfect_data": "CLEAN_CLEAN",
}


def joined_name(*parts: Column | str | None) -> Column:
    """Parts joined by ``_``; missing parts are left out."""
    present = [p if isinstance(p, Column) else F.lit(p) for p in parts if p is not None]
    return F.concat_ws("_", *present)


def evaluation_name(
    task: str, samples: str | None = None, ground_truth: str | None = None,
    metric: str | None = None, scenario: str | None = None,
) -> str:
    """Metric name of a configuration, for example ``LP_ALL_TLGT``."""
    parts = [
        TASKS[task],
        SAMPLES[samples] if samples else None,
        GROUND_TRUTHS[ground_truth] if ground_truth else None,
        METRICS[metric] if metric else None,
        SCENARIOS[scenario] if scenario else None,
    ]
    return "_".join(p for p in parts if p)


def split_type_and_rate(name: Column) -> tuple[Column, Column]:
    """Error type and rate out of a name such as ``MCAR_20``."""
    pieces = F.split(name, "_")
    return F.element_at(pieces, 1), F.element_at(pieces, 2).cast("int")


def dataset_name(dataset_id: Column, prefix: str = "OpenML") -> Column:
    return F.concat(F.lit(prefix + "-"), dataset_id.cast("string"))


def dataset_id(name: Column) -> Column:
    return F.substring_index(name, "-", -1).cast("bigint")


def record_id(*parts: Column) -> Column:
    """Repeatable id of a record: digest of its natural key."""
    return F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def flatten_one_level(nested: Column) -> Column:
    return F.flatten(nested)


def encode_list(values: Column) -> Column:
    return F.to_json(values)


def test_side_rows(document: Column) -> Column:
    """Row list of the test side from ``[..]`` or ``[[train..], [test..]]``."""
    is_nested = F.regexp_like(document, F.lit(r"^\s*\[\s*\["))
    pairs = F.from_json(document, "array<array<bigint>>")
    flat = F.from_json(document, "array<bigint>")
    return F.when(is_nested, F.try_element_at(pairs, F.lit(2))).otherwise(flat)
