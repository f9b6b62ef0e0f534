"""Seeded digests: the one source of randomness in the library.

Every draw orders rows by ``md5(seed:purpose:key)``. The order depends on the
row only, so a sample is the same for any partitioning and after any retry.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = float(2**32)


def _column(value: Column | str | int) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value))


def digest(seed: Column | int, purpose: Column | str, *keys: Column | str) -> Column:
    """32 hex digits per row; string keys are column names."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", _column(seed), _column(purpose), *[p.cast("string") for p in parts]))


def leading_number(digest_column: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as a whole number."""
    return F.conv(F.substring(digest_column, 1, digits), 16, 10).cast("bigint")


def uniform(digest_column: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits."""
    return leading_number(digest_column) / F.lit(UNIT)


def text_digest(seed: int, purpose: str, key: str) -> str:
    """The same digest for names known on the driver, such as columns."""
    return hashlib.md5(f"{seed}:{purpose}:{key}".encode()).hexdigest()


def row_key(*columns: str) -> Column:
    """Key for a table without one: digest over the listed columns."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
