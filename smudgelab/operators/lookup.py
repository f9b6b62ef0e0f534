"""Joins against a lookup side whose size is not known in advance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_on(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner", hint: bool = False) -> DataFrame:
    """Equi-join on columns of the same name in which null equals null.

    The result has the columns of ``df``, then the others of ``other``.
    """
    names = {k: f"join_key_{i}" for i, k in enumerate(on)}
    renamed = other.select(
        *[F.col(k).alias(n) for k, n in names.items()], *[c for c in other.columns if c not in names]
    )
    if hint:
        renamed = F.broadcast(renamed)
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(renamed, equal, how).drop(*names.values())


def lookup_join(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join to a lookup with one row per key, whatever the skew of ``df``.

    A lookup of checked size is broadcast. A larger one is repeated under each
    salt, so the rows of a hot key are spread over ``SALTS`` tasks.
    """
    on = list(on)
    if is_small(lookup, rows):
        return join_on(df, lookup, on, how, hint=True)
    return _salted_join(df, lookup, on, how)


def join_pinned(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], rows: int, how: str = "inner"
) -> DataFrame:
    """As ``lookup_join`` for a costly lookup: it is computed once, here.

    Up to ``rows`` rows pass through the driver; beyond that the lookup stays a
    distributed frame and is joined under salts.
    """
    held = lookup.limit(rows + 1).toArrow()
    if held.num_rows <= rows:
        known = df.sparkSession.createDataFrame(held, lookup.schema)
        return join_on(df, known, on, how, hint=True)
    return _salted_join(df, lookup, list(on), how)


def _salted_join(df: DataFrame, lookup: DataFrame, on: list[str], how: str) -> DataFrame:
    # A row's place, not its content, so that equal rows are spread, too. Which salt a row
    # has changes nothing: the lookup is the same under all of them.
    salted = df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    repeated = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(salted, repeated, [*on, "salt"], how).drop("salt")
