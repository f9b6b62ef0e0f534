"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) is
applied to unit vectors; a vector's hash is the signed axis nearest to it. Several
rotations give several tables. A query looks into the buckets of its nearest axes in each
table (multiprobe), and what lies there is ranked by its exact inner product. Where
lengths differ, vectors are filed in rings of similar length, and a coordinate is added that makes
all vectors of a ring equally long and leaves inner products with queries as they are, so within a
ring the largest product is the smallest angle; a query looks into every ring. Queries that meet
fewer candidates than they want are compared with all vectors, block by block.

Equal vectors are one candidate with the smallest ids of its rows, so a vector that a
third of all rows share costs one. Buckets are cut into blocks of bounded size by a
count of rows per bucket (at most tables x axes counts); queries go to every block of a bucket
they probe. A block returns each query's best candidates only, never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do vectors of another length than most (of the longer, if lengths tie). Rows that repeat an id take
part as one id with each of their vectors, ranked by its best. Fewer candidates than wanted: all that are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import bounded_batches, stored

#: Tables, and probes per table as a share of its buckets.
TABLES = 12
PROBE_SHARE = 10 / 128
#: Lengths of a ring differ by this factor at most.
RING = 1.2
#: Vectors of a bucket that one task compares at once.
BLOCK = 8192


#: What tells blocks of vectors apart.
FILED = ("table", "ring", "bucket", "block")


class Rotations:
    """Pseudo-rotations of padded vectors, one per table."""

    def __init__(self, dimension: int, tables: int = TABLES, seed: int = 11) -> None:
        self.width = 1 << max(0, (dimension - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], size=(tables, 3, self.width))

    def turn(self, vectors: np.ndarray, table: int) -> np.ndarray:
        x = np.zeros((len(vectors), self.width))
        x[:, : vectors.shape[1]] = vectors
        for signs in self.signs[table]:
            x = _hadamard(x * signs)
        return x

    def axes(self, vectors: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` nearest signed axes, nearest first: 2 * axis, 1 more if negative."""
        x = self.turn(vectors, table)
        both = np.stack((x, -x), axis=2).reshape(len(x), -1)
        if most == 1:
            return both.argmax(axis=1)[:, None]
        return np.argsort(-both, axis=1, kind="stable")[:, :most]


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        x = x.reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def _usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dimension)


def _ring_of(norm: np.ndarray, longest: float) -> np.ndarray:
    """0 for the longest vectors, one more for every factor ``RING``."""
    return np.maximum(0, np.floor(np.log(longest / norm) / np.log(RING) + 1e-9)).astype(np.int32)


def _rings(dimension: int, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                norm = np.linalg.norm(_matrix(batch.column("vector"), dimension), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_ring_of(norm, longest)))], ["ring"])

    return run


def _filed(rotations: Rotations, dimension: int, longest: float, rings: list[int], probes: int):
    """Rows (table, ring, bucket, query, rep, vector): once as a point, and in each ring as a query
    if it is one. Without rings all vectors are equally long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), dimension)
            norm = np.linalg.norm(vectors, axis=1)
            unit = vectors / norm[:, None]
            point, ring = unit, np.zeros(len(unit), dtype=np.int32)
            if rings:
                ring = _ring_of(norm, longest)
                top = longest / RING**ring
                rest = np.sqrt(np.maximum(0.0, 1.0 - (norm / top) ** 2))
                point = np.column_stack((vectors / top[:, None], rest))
                unit = np.column_stack((unit, np.zeros(len(unit))))
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            every = np.array(rings or [0], dtype=np.int32)
            for table in range(len(rotations.signs)):
                probed = rotations.axes(unit[asks], table, probes).ravel() if len(asks) else np.empty(0)
                row = np.concatenate([np.arange(len(vectors)), np.tile(np.repeat(asks, probes), len(every))])
                buckets = np.concatenate([rotations.axes(point, table, 1)[:, 0], np.tile(probed, len(every))])
                chosen = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), table, dtype=np.int32)),
                        pa.array(np.concatenate([ring, np.repeat(every, len(probed))])),
                        pa.array(buckets.astype(np.int32)),
                        pa.array(np.arange(len(row)) >= len(vectors)),
                        batch.column("rep").take(chosen),
                        batch.column("vector").take(chosen),
                    ],
                    ["table", "ring", "bucket", "query", "rep", "vector"],
                )

    return run


def _best(scores: np.ndarray, points: np.ndarray, reps: np.ndarray, query: np.ndarray, k: int):
    """The k best points of one query: exact products, ties to the smaller rep."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        # A matrix product may round otherwise than the exact one below.
        near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    else:
        near = np.arange(len(scores))
    exact = (points[near] * query).sum(axis=1)
    order = np.lexsort((reps[near], -exact))[:k]
    return reps[near][order], exact[order]


def _ranked(dimension: int, k: int):
    """The best points of each query of a block; points come before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None
        points: list[np.ndarray] = []
        reps: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in FILED]
            asks = batch.column("query").to_numpy(zero_copy_only=False)
            rep = batch.column("rep").to_numpy()
            vectors = _matrix(batch.column("vector"), dimension)
            new = np.zeros(len(rep), dtype=bool)
            for column in (*keys, asks):
                new[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(rep)]
            found: list[tuple] = []
            for at, to in zip(cuts, cuts[1:], strict=False):
                key = tuple(int(column[at]) for column in keys)
                if key != open_key:
                    open_key, points, reps = key, [], []
                if not asks[at]:
                    points.append(vectors[at:to])
                    reps.append(rep[at:to])
                    continue
                if not points:
                    continue
                points, reps = [np.concatenate(points)], [np.concatenate(reps)]
                for part in range(at, to, 256):
                    queries = vectors[part : min(to, part + 256)]
                    for row, scores in enumerate(queries @ points[0].T):
                        best, exact = _best(scores, points[0], reps[0], queries[row], k)
                        found.append((np.full(len(best), rep[part + row]), best, exact))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found])) for i in range(3)],
                    ["query", "rep", "score"],
                )

    return run


def search(
    df: DataFrame,
    asks: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probe_share: float = PROBE_SHARE,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of largest inner product of each row
    that ``asks``, the row itself left out; ties to the smaller id."""
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), asks.alias("asks")
    ).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    result = "query_id long, rank int, id long, score double"
    if top is None:
        return df.sparkSession.createDataFrame([], result)
    dimension = top["n"]
    rows = rows.where(F.size("vector") == dimension)
    # Of equal vectors, the k + 1 smallest ids are enough: k besides the query's own.
    by_vector = Window.partitionBy("vector").orderBy("id")
    few = rows.select("id", "vector").distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    known = few.groupBy("vector").agg(
        F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    asking = rows.where("asks").groupBy("vector").agg(F.lit(True).alias("asks"))
    points = stored(
        known.join(asking, "vector", "left").select(
            # An id may come with several vectors: the vector tells their points apart.
            F.xxhash64("rep", "vector").alias("rep"), "ids", "vector", F.coalesce("asks", F.lit(False)).alias("asks")
        ),
        "points",
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norms = points.agg(F.min(squares), F.max(squares)).first()
    longest = float(norms[1]) ** 0.5
    lift = norms[1] - norms[0] > 1e-6 * norms[1]
    rings = []
    if lift:
        found = points.select("vector").mapInArrow(_rings(dimension, longest), "ring int").distinct()
        rings = sorted(r["ring"] for r in found.collect())  # lengths of doubles make some thousands at most
    rotations = Rotations(dimension + lift, tables)
    probes = max(1, round(2 * rotations.width * probe_share))
    vector_type = points.schema["vector"].dataType.simpleString()
    filed = points.select("rep", "vector", "asks").mapInArrow(
        _filed(rotations, dimension, longest, rings, probes),
        f"table int, ring int, bucket int, query boolean, rep long, vector {vector_type}",
    )
    filed = stored(filed, "filed")
    # At most tables x rings x axes rows, so this may go to every executor.
    blocks = (
        filed.where("not query").groupBy("table", "ring", "bucket").count()
        .select("table", "ring", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = filed.join(F.broadcast(blocks), ["table", "ring", "bucket"])
    lists = stored(_lists(dealt, points, dimension, k), "lists")
    # Queries that met too few: all vectors, in blocks of bounded size.
    short = points.where("asks").join(
        lists.where(F.size("best") > k).select(F.col("query").alias("rep")), "rep", "left_anti"
    )
    short = stored(short.select("rep", "vector"), "short")
    if not short.isEmpty():
        whole = max(1, -(-points.count() // BLOCK))
        same = [F.lit(0).alias(c) for c in ("table", "ring", "bucket")]
        both = points.select(*same, F.lit(False).alias("query"), "rep", "vector").unionByName(
            short.select(*same, F.lit(True).alias("query"), "rep", "vector")
        )
        exact = _lists(both.withColumn("blocks", F.lit(whole)), points, dimension, k)
        lists = lists.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(exact)
    lists = lists.join(points.select(F.col("rep").alias("query"), "vector"), "query")
    answered = rows.where("asks").select("id", "vector").distinct().join(lists, "vector").select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)).alias("at", "b"),
    )
    # The id inside the lambda is the row's own; an id with several vectors is merged.
    answered = answered.groupBy("query_id", F.col("b.id").alias("id")).agg(F.max(-F.col("b.down")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        answered.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def _lists(dealt: DataFrame, points: DataFrame, dimension: int, k: int) -> DataFrame:
    """(query, best): the k + 1 best ids of each query over the blocks it was dealt to."""
    own = F.array(F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = (
        dealt.withColumn("block", F.explode(F.when(F.col("query"), every).otherwise(own)))
        .select(*FILED, "query", "rep", "vector")
        .repartition(*FILED)
        .sortWithinPartitions(*FILED, "query")
    )
    found = placed.mapInArrow(_ranked(dimension, k + 1), "query long, rep long, score double")
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (
        found.groupBy("query", "rep").agg(F.max("score").alias("score"))
        .join(points.select("rep", "ids"), "rep")
        .select("query", "score", F.explode("ids").alias("id"))
        .groupBy("query", "id").agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(best_first))
        .where(F.col("place") <= k + 1)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("best"))
    )
