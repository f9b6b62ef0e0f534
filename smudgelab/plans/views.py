"""Planar views of raw, clean and damaged data of one experiment."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.operators.lookup import lookup_join
from smudgelab.operators.columns import column_modes, label_codes
from smudgelab.operators.planar import mirror, project_2d
from smudgelab.operators.subsets import flag_corrupted, keep_first, not_broadcast, test_side
from smudgelab.session import work_folder

# Panel names and mirror directions.
RAW, CLEAN = "RAW", "CLEAN"
FLIPS = {"FLIP_HOR": (True, False), "FLIP_VER": (False, True), "FLIP_BOTH": (True, True)}


def raw_vectors(test_rows: DataFrame, dataset: S.DatasetSpec) -> DataFrame:
    """(row_id, embedding): mode-filled features, categories one-hot encoded."""
    modes = {r["column"]: r["mode"] for r in column_modes(test_rows, dataset.features).collect()}
    filled = test_rows.withColumns(
        {
            c: F.coalesce(F.col(c).cast(kind), F.lit(modes.get(c)).cast(kind))
            for names, kind in ((dataset.numeric, "double"), (dataset.categorical, "string"))
            for c in names
        }
    )
    parts = [F.array(*[F.col(c) for c in dataset.numeric]).cast("array<double>")]
    for c in dataset.categorical:
        code = f"code__{c}"
        codes = label_codes(filled, c, code)
        size = codes.count()  # the values themselves stay where they are
        filled = lookup_join(filled, codes, [c])
        if size:
            parts.append(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), _is_code(F.col(code))))
    return filled.select(F.col(dataset.key).cast("string").alias("row_id"), F.concat(*parts).alias("embedding"))


def _is_code(code: Column) -> Callable[[Column], Column]:
    return lambda i: F.coalesce((i == code).cast("double"), F.lit(0.0))


def _by_run(rows: DataFrame) -> DataFrame:
    """Rows written to the work place once, a folder for each run."""
    path = f"{work_folder(rows.sparkSession)}/views-{uuid.uuid4().hex}"
    rows.write.partitionBy("experiment_id").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def planar_view(
    experiment_id: str,
    experiments: DataFrame,
    embeddings: DataFrame,
    manifest: DataFrame,
    raw: DataFrame | None = None,
    flips: Mapping[str, str] | None = None,
    percents: Sequence[int] = S.DEFAULT_ROW_PERCENTS,
) -> DataFrame:
    """(panel, row_id, x, y, label, label_code, is_corrupted) of an experiment.

    Panels are the raw table, the clean embeddings, and the embeddings of the same
    dataset, tag, error type and seed at each row percent. A panel whose experiment
    is not stored is left out.
    """
    chosen = experiments.where(F.col("experiment_id") == experiment_id).first()
    if chosen is None:
        raise ValueError(f"no experiment {experiment_id}")
    same = (F.col("dataset_name") == chosen["dataset_name"]) & (F.col("random_seed") == chosen["random_seed"])
    wanted: dict[str, Column] = {CLEAN: (F.col("tag") == S.CLEAN_CLEAN) & (F.col("error_type") == S.NONE)}
    for percent in percents:
        wanted[f"COR_{percent}"] = (
            (F.col("tag") == chosen["tag"])
            & (F.col("error_type") == chosen["error_type"])
            & (F.col("row_corruption_percent") == percent)
        )
    kept = keep_first(embeddings, experiments.where(same), ["experiment_id"], "test_size")
    matches = {panel: experiments.where(same & condition).orderBy("experiment_id").first() for panel, condition in wanted.items()}
    needed = {experiment_id} | {m["experiment_id"] for m in matches.values() if m is not None}
    # The runs' rows lie mixed among those of all others; each panel is then read several times.
    kept = _by_run(kept.where(F.col("experiment_id").isin(sorted(needed))))
    flagged = flag_corrupted(
        kept.where(F.col("experiment_id") == experiment_id).select("experiment_id", "row_id", "label"),
        test_side(manifest),
        ["experiment_id", "row_id"],
    ).drop("experiment_id")
    panels = {}
    for panel, match in matches.items():
        if match is not None:
            panels[panel] = kept.where(F.col("experiment_id") == match["experiment_id"])
    if raw is not None:
        panels[RAW] = raw
    result = None
    for panel, rows in panels.items():
        flat = project_2d(rows, "embedding", ["row_id"]).withColumn("panel", F.lit(panel))
        horizontally, vertically = FLIPS.get((flips or {}).get(panel, ""), (False, False))
        flat = mirror(flat, ["panel"], horizontally, vertically)
        result = flat if result is None else result.unionByName(flat)
    coded = lookup_join(flagged, label_codes(flagged, "label", "label_code"), ["label"])
    return result.join(not_broadcast(coded), "row_id").select("panel", "row_id", "x", "y", "label", "label_code", "is_corrupted")
