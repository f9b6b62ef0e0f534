"""Lists and matrices as stored documents of bounded size.

A list that belongs to one experiment may be long; it is stored in parts, so no
task ever holds a whole one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab.functions.hashing import digest
from smudgelab.operators.ranking import biggest_group, digest_rank

PART_ROWS = 10_000


def in_parts(df: DataFrame, group: Sequence[str], key: Sequence[str], rows: int = PART_ROWS) -> DataFrame:
    """Adds ``part``: at most ``rows`` rows of a group share one. Rows are ranked only if some group needs parts."""
    if biggest_group(df, group) <= rows:
        return df.withColumn("part", F.lit(0).cast("bigint"))
    ranked = digest_rank(df.withColumn("d", digest(0, "part", *key)), "d", group)
    return ranked.withColumn("part", F.floor(F.col("pos") / rows).cast("bigint")).drop("d", "pos")


def row_documents(
    df: DataFrame, group: Sequence[str], row: str, nested: Column, is_train: Column, rows: int = PART_ROWS
) -> DataFrame:
    """(group.., part, document): row ids as JSON, flat or as [train, test].

    ``nested`` says per group which of the two shapes is written.
    """
    keyed = in_parts(df.withColumns({"nested": nested, "is_train": is_train}), group, [*group, row], rows)
    value = F.col(row).cast("bigint")
    lists = keyed.groupBy(*group, "nested", "part").agg(
        F.array_sort(F.collect_list(value)).alias("flat"),
        F.array_sort(F.collect_list(F.when(F.col("is_train"), value))).alias("train"),
        F.array_sort(F.collect_list(F.when(~F.col("is_train"), value))).alias("test"),
    )
    document = F.when(F.col("nested"), F.to_json(F.array("train", "test"))).otherwise(F.to_json("flat"))
    return lists.select(*group, "part", document.alias("document"))


def matrices(df: DataFrame, group: Sequence[str], pos: str, vector: str, rows: int = PART_ROWS) -> DataFrame:
    """(group.., part, matrix): vectors in position order, at most ``rows`` per matrix."""
    part = F.floor(F.col(pos) / rows).cast("bigint").alias("part")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vector).alias("v"))))
    return df.groupBy(*group, part).agg(F.transform(pairs, lambda s: s["v"]).alias("matrix"))


def matrix_rows(df: DataFrame, group: Sequence[str], rows: int = PART_ROWS) -> DataFrame:
    """(group.., pos, embedding) out of matrices in parts."""
    spread = df.select(*group, "part", F.posexplode("matrix").alias("place", "embedding"))
    return spread.select(*group, (F.col("part") * rows + F.col("place")).alias("pos"), "embedding")
