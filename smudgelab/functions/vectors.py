"""Arithmetic on ``array<double>`` columns; runs inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A column used inside a lambda would be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Vector of length one; null for a zero vector."""
    return let(norm(a), lambda length: F.when(length > 0, F.transform(a, lambda x: x / length)))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def z_normalize(a: Column) -> Column:
    """Centre and scale one vector by its own population deviation.

    A constant vector becomes zeros.
    """

    def scaled(shifted: Column) -> Column:
        deviation = norm(shifted) / F.sqrt(F.size(shifted).cast("double"))
        return let(
            deviation,
            lambda d: F.transform(shifted, lambda x: F.when(d > 0, x / d).otherwise(F.lit(0.0))),
        )

    return let(let(mean(a), lambda centre: F.transform(a, lambda x: x - centre)), scaled)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; null when a vector is all zeros."""
    return let(norm(a) * norm(b), lambda length: F.when(length > 0, F.lit(1.0) - dot(a, b) / length))


def softmax(scores: Column) -> Column:
    """Exponentials of a row, shifted by its largest score, over their sum."""
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(total(p), lambda whole: F.transform(p, lambda x: x / whole)))


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
