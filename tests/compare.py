"""Order-free comparison of a query with its expected SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(f"{folder}/{t}.parquet")
        if path.exists():
            files = f"{path}/*.parquet" if path.is_dir() else path
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    return con


def _cell(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


def differences(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None when equal, else a short description."""
    names = sorted(df.columns)
    got = sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns {names} vs {sorted(found)}"
    place = [found.index(n) for n in names]
    want = sorted(tuple(_cell(r[i]) for i in place) for r in cursor.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} of {len(got)} rows differ, first {wrong[:2]}" if wrong else None
