"""Sizes and limits."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

from smudgelab.spec import MAX_CLASSES, MAX_FEATURES, MAX_TRAIN_ROWS

NEAR_LIMIT = 0.8
#: Rows that a model is given at once where nothing nears its limits.
INFERENCE_ROWS = MAX_TRAIN_ROWS


def sample_size(percent: float, count: int) -> int:
    """Rows or columns to damage: the whole part of the share, at least one."""
    return max(int(percent * count / 100), 1)


def test_rows(count: int, test_size: float) -> int:
    return ceil(test_size * count)


def inference_limit(rows: Column, features: Column, classes: Column) -> Column:
    """Batch limit, cut to 80 % for every dimension that nears its own limit."""
    limit: Column = F.lit(MAX_TRAIN_ROWS)
    for size, most in ((rows, MAX_TRAIN_ROWS), (features, MAX_FEATURES), (classes, MAX_CLASSES)):
        limit = F.when(size > NEAR_LIMIT * most, F.floor(limit * NEAR_LIMIT)).otherwise(limit)
    return limit.cast("int")


def batch_rows(rows: int, features: int, classes: int) -> int:
    """``inference_limit`` of one model, known on the driver."""
    limit = INFERENCE_ROWS
    for size, most in ((rows, MAX_TRAIN_ROWS), (features, MAX_FEATURES), (classes, MAX_CLASSES)):
        if size > NEAR_LIMIT * most:
            limit = int(limit * NEAR_LIMIT)
    return limit


def fraction(percent: Column) -> Column:
    return percent / F.lit(100.0)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)
