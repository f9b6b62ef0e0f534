"""Synthetic rows that follow the columns and correlations of a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab.functions.hashing import digest, uniform

QUANTILES = 200


def _normal(seed: int, name: str) -> Column:
    """Standard normal per ``synthetic_id`` from two seeded uniforms."""
    first = uniform(digest(seed, f"radius:{name}", "synthetic_id"))
    second = uniform(digest(seed, f"angle:{name}", "synthetic_id"))
    return F.sqrt(-2 * F.log(1 - first)) * F.cos(2 * F.pi() * second)


def _normal_share(z: Column) -> Column:
    """Share of a standard normal below z (rational approximation, error below 1e-7)."""
    # Coefficients of the classic five-term approximation of erf.
    p, terms = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    series: Column = F.lit(0.0)
    for c in reversed(terms):
        series = (series + c) * t
    erf = 1 - series * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def synthesize(
    df: DataFrame, columns: Sequence[str], seed: int, times: int = 3, spread: float = 1.0
) -> DataFrame:
    """``times`` as many rows as ``df`` has, for the chosen numeric columns.

    Correlated normals are turned into shares and read off each column's
    quantiles; ``spread`` below 1 draws closer to the middle.
    """
    columns = list(columns)
    levels = [i / QUANTILES for i in range(QUANTILES + 1)]
    present = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    facts = present.agg(
        F.count("*").alias("n"),
        *[F.percentile_approx(c, levels, 10_000).alias(f"q:{c}") for c in columns],
        *[
            F.corr(a, b).alias(f"r:{i}:{j}")
            for i, a in enumerate(columns)
            for j, b in enumerate(columns)
            if i < j
        ],
    ).first()
    together = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            value = facts[f"r:{i}:{j}"]
            together[i, j] = together[j, i] = 0.0 if value is None or np.isnan(value) else value
    mix = np.linalg.cholesky(together * (1 - 1e-9) + np.eye(len(columns)) * 1e-9)
    ids = df.sparkSession.range(facts["n"] * times).withColumnRenamed("id", "synthetic_id")
    drawn = ids.withColumns({f"z:{c}": _normal(seed, c) * F.lit(spread) for c in columns})
    result = {}
    for i, c in enumerate(columns):
        z: Column = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.lit(float(mix[i, j])) * F.col(f"z:{columns[j]}")
        grid = F.array(*[F.lit(float(q)) for q in facts[f"q:{c}"]])
        place = _normal_share(z) * QUANTILES
        low = F.least(F.floor(place), F.lit(QUANTILES - 1)).cast("int")
        left, right = F.element_at(grid, low + 1), F.element_at(grid, low + 2)
        result[c] = left + (right - left) * (place - low)
    return drawn.withColumns(result).select("synthetic_id", *columns)
