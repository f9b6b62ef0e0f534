"""Two-dimensional views of vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smudgelab.functions.vectors import as_doubles
from smudgelab.operators.lookup import join_pinned

MIRROR_GROUPS = 20_000


def project_2d(df: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """(keep.., x, y): standardise, first two principal components, standardise.

    Each component is turned so that its largest loading is positive.
    """
    rows = df.select(*keep, array_to_vector(as_doubles(F.col(vector))).alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(rows)
    scaled = scaler.transform(rows)
    model = PCA(k=2, inputCol="scaled", outputCol="planar").fit(scaled)
    loadings = model.pc.toArray()
    turns = [float(np.sign(loadings[np.abs(loadings[:, i]).argmax(), i])) or 1.0 for i in range(2)]
    plane = vector_to_array("planar")
    flat = model.transform(scaled).select(
        *keep, *[(plane[i] * F.lit(turns[i])).alias(name) for i, name in enumerate("xy")]
    )
    spread = flat.agg(*[F.stddev_pop(c).alias(c) for c in "xy"]).first()
    return flat.withColumns({c: F.col(c) / F.lit(spread[c]) if spread[c] else F.lit(0.0) for c in "xy"})


def mirror(
    df: DataFrame, group: Sequence[str], horizontally: bool = False, vertically: bool = False
) -> DataFrame:
    """x → largest x − x and/or y → largest y − y inside each group."""
    flips = [c for c, wanted in (("x", horizontally), ("y", vertically)) if wanted]
    if not flips:
        return df
    tops = df.groupBy(*group).agg(*[F.max(c).alias(f"{c}_top") for c in flips])
    joined = join_pinned(df, tops, list(group), MIRROR_GROUPS)
    return joined.withColumns({c: F.col(f"{c}_top") - F.col(c) for c in flips}).drop(*[f"{c}_top" for c in flips])
