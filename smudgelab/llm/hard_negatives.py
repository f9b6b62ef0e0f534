"""Hard negatives by exact search over zone maps.

Vectors are put in order along a Hilbert curve and written as Parquet, cut into blocks. A
block holds its vectors packed together and a zone map: the least and largest value of each
dimension. Interval arithmetic on a zone map bounds the inner products of an anchor with all
vectors of the block, so a block is read only if its bounds reach into a window of scores that an
anchor still looks for: first the scores of its best positives, then, for each positive, the
range in which negatives are hard. Directories of neighbouring blocks ("cells") that no
anchor needs are not read at all. The result is exact whatever the order and the bounds; they
only save work, and save little where vectors fill space evenly.

Anchors are taken ``ANCHORS_AT_ONCE`` together, those of neighbouring cells, and go to the tasks as
a broadcast of that size at most. They look into their own cells first, which raises what others must
reach. A task keeps the best of all its blocks and returns those alone, so pairs never become rows.

Vectors become whole numbers: component x is floor(scale * x). Sums of products are exact: as
doubles where they stay below 2^53, else as Python integers.

Defined results: rows with a null id, label, vector or component, or a component that is not
finite, take no part; labels are whole numbers. Rows that repeat an id each take part, but a row
with the anchor's id is never its positive or negative. Missing components of shorter vectors count as
zero. Scaled components and scores beyond a long are its largest or smallest value. Ties go to the
smaller id. Other columns of the input are not read, so none can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import bounded_batches, sampled, shared_folder

#: Vectors and bytes of a block; directories that blocks lie in; rows of one sorting task.
BLOCK, BLOCK_BYTES, CELLS, SORTED_TOGETHER = 4096, 4 << 20, 1024, 1_000_000
#: Anchors that search together, and bytes of their vectors.
ANCHORS_AT_ONCE, ANCHOR_BYTES = 16_384, 64 << 20
#: The curve: dimensions it runs through (those that vary most) and bits of each. Its grid is
#: fitted on so many rows; it steers the order of vectors, never a result.
AXES, BITS, FITTED = 64, 4, 2_000
#: Rows of scores that a task holds at once.
PART = 256
NONE = -np.iinfo(np.int64).max
MOST = np.iinfo(np.int64).max
_EXACT = float(1 << 53)
_BLOCKS = "ids array<long>, labels array<long>, asks array<boolean>, low array<long>, high array<long>, kind string, vectors binary"


@dataclass(frozen=True)
class Grid:
    """Dimensions the curve runs through, and the cuts that make coordinates of their values."""

    axes: np.ndarray
    cuts: np.ndarray  # (axes, 2^BITS - 1)

    @classmethod
    def fit(cls, vectors: np.ndarray) -> Grid:
        axes = np.argsort(-vectors.var(axis=0), kind="stable")[:AXES] if len(vectors) else np.arange(0)
        shares = np.arange(1, 1 << BITS) / (1 << BITS)
        cuts = np.quantile(vectors[:, axes], shares, axis=0).T if len(axes) else np.zeros((0, len(shares)))
        return cls(axes, cuts)

    def keys(self, vectors: np.ndarray) -> list[bytes]:
        """Places on the curve, as bytes whose order is the curve's."""
        at = [np.searchsorted(c, vectors[:, a], side="right") for a, c in zip(self.axes, self.cuts, strict=True)]
        return hilbert_keys(np.array(at, dtype=np.uint32).reshape(len(self.axes), len(vectors)), BITS)


def hilbert_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Hilbert index of points with coordinates ``x`` (dimensions, points) of ``bits`` bits.

    Undoes the excess rotations and reflections bit by bit from the top, then Gray-codes.
    """
    x, n = x.copy(), len(x)
    if not n:
        return [b""] * x.shape[1]
    for bit in range(bits - 1, 0, -1):
        below = np.uint32((1 << bit) - 1)
        for i in range(n):
            is_set = (x[i] >> np.uint32(bit)) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & below).astype(np.uint32)
            x[0] ^= np.where(is_set, below, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint32)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(bit)) & 1 == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip
    order = [(x >> np.uint32(bit)) & 1 for bit in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(order).astype(np.uint8), axis=0).T
    return [row.tobytes() for row in packed]


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, filled up with zeros."""
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return out


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as long; what lies beyond a long is its end."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * values)
    inside = np.abs(whole) < 2.0**63
    return np.where(inside, np.where(inside, whole, 0).astype(np.int64), np.where(whole > 0, MOST, NONE))


def _keyed(grid: Grid, width: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = grid.keys(scaled(padded(batch.column("vector"), width), scale).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])

    return run


def _blocked(width: int, scale: float, block: int):
    """Rows in the order of the curve to one row per block; a block's rows are by id."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().sort_by("id")
        vectors = scaled(padded(rows["vector"].combine_chunks(), width), scale)
        kind = next((t for t in ("int16", "int32") if np.abs(vectors).max(initial=0) <= np.iinfo(t).max), "int64")
        cells = [
            rows["id"].to_numpy(),
            rows["label"].to_numpy(),
            rows["asks"].to_numpy(),
            vectors.min(axis=0),
            vectors.max(axis=0),
        ]
        arrays = [pa.array([c.tolist()]) for c in cells]
        arrays += [pa.array([kind]), pa.array([vectors.astype(kind).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "labels", "asks", "low", "high", "kind", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= block:
                rows = pa.Table.from_batches(waiting)
                yield one(rows.slice(0, block))
                waiting, n = rows.slice(block).to_batches(), n - block
        if n:
            yield one(pa.Table.from_batches(waiting))

    return run


def _vectors(kind: str, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(n, -1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(row["asks"])
            if len(at):
                vectors = _vectors(row["kind"], row["vectors"], len(row["ids"]))[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["cell"]] * len(at), pa.int32()),
                        pa.array(np.array(row["ids"])[at]),
                        pa.array(np.array(row["labels"])[at]),
                        pa.array(vectors.tolist(), pa.list_(pa.int64())),
                    ],
                    ["cell", "id", "label", "vector"],
                )


@dataclass
class Asked:
    """Anchors and the windows of scores (anchors, windows) that they look into."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # (anchors, width) long
    low: np.ndarray
    high: np.ndarray
    same: bool  # look for the anchor's label, or for others
    k: int

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the products with all vectors between ``low`` and ``high``."""
        if not hasattr(self, "_sides"):
            real = self.vectors.astype(np.float64)
            self._sides = np.maximum(real, 0), np.minimum(real, 0)
        up, down = self._sides
        low, high = low.astype(np.float64), high.astype(np.float64)
        # What rounding may take away where sums are too large to be exact.
        slack = (up - down) @ np.maximum(np.abs(low), np.abs(high)) * 1e-12
        return up @ low + down @ high - slack, up @ high + down @ low + slack

    def needs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which anchors have a window that the bounds of a block reach into."""
        least, most = self.bounds(low, high)
        return ((most[:, None] >= self.low) & (least[:, None] <= self.high) & (self.low <= self.high)).any(axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs, as longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, NONE, MOST).astype(np.int64)


class Best:
    """The best scores of every window so far."""

    def __init__(self, asked: Asked) -> None:
        self.asked = asked
        shape = (*asked.low.shape, asked.k)
        self.scores = np.full(shape, NONE, dtype=np.int64)
        self.ids = np.full(shape, MOST, dtype=np.int64)

    def look(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        rows = np.flatnonzero(self.asked.needs(low, high))
        for start in range(0, len(rows), PART):
            self._part(rows[start : start + PART], ids, labels, vectors)

    def _part(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        asked, k, n = self.asked, self.asked.k, len(ids)
        scores = products(asked.vectors[rows], vectors)
        fits = (labels == asked.labels[rows][:, None]) == asked.same
        fits &= ids != asked.ids[rows][:, None]
        # One key for score and place: rows of a block are by id, so ties go to the smaller one.
        small = np.abs(scores).max(initial=0) < _EXACT / (n + 1)
        key = scores.astype(np.float64) * n - np.arange(n) if small else None
        for w in range(asked.low.shape[1]):
            inside = fits & (scores >= asked.low[rows, w][:, None]) & (scores <= asked.high[rows, w][:, None])
            if not inside.any():
                continue
            if n <= k:
                at = np.broadcast_to(np.arange(n), (len(rows), n))
            elif small:
                at = np.argpartition(np.where(inside, key, -np.inf), n - k, axis=1)[:, n - k :]
            else:
                down = np.where(inside, -scores, MOST)
                at = np.argsort(down, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(inside, at, axis=1)
            more = np.where(found, np.take_along_axis(scores, at, axis=1), NONE)
            named = np.where(found, ids[at], MOST)
            both = np.concatenate((self.scores[rows, w], more), axis=1)
            names = np.concatenate((self.ids[rows, w], named), axis=1)
            order = np.lexsort((names, -both), axis=-1)[:, :k]
            self.scores[rows, w] = np.take_along_axis(both, order, axis=1)
            self.ids[rows, w] = np.take_along_axis(names, order, axis=1)
            # What comes later must be as good as the last of a full list.
            asked.low[rows, w] = np.maximum(asked.low[rows, w], self.scores[rows, w, k - 1])

    def batch(self) -> pa.RecordBatch:
        anchor, window, place = np.nonzero(self.ids != MOST)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor.astype(np.int32)),
                pa.array(window.astype(np.int32)),
                pa.array(self.ids[anchor, window, place]),
                pa.array(self.scores[anchor, window, place]),
            ],
            ["anchor", "window", "id", "score"],
        )


def _own_copy(asked: Asked) -> Asked:
    """A task raises its own lower ends only; workers share what was broadcast."""
    return Asked(asked.ids, asked.labels, asked.vectors, asked.low.copy(), asked.high, asked.same, asked.k)


def _searched(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(_own_copy(shared.value))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, labels, low, high = (
                    row[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels", "low", "high")
                )
                vectors = _vectors(row["kind"].as_py(), row["vectors"].as_py(), len(ids))
                best.look(ids, labels, vectors, low, high)
        yield best.batch()

    return run


def _reached(shared: Broadcast):
    """The cells whose zone maps reach into a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        for batch in batches:
            lows, highs = (
                [x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("low", "high")
            )
            hit = [bool(asked.needs(a, b).any()) for a, b in zip(lows, highs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cell").filter(pa.array(hit, pa.bool_()))], ["cell"])

    return run


class Blocks:
    """Vectors in blocks along a Hilbert curve, with their zone maps."""

    def __init__(self, rows: DataFrame, scale: float, block: int = BLOCK) -> None:
        """``rows``: id, label, vector, asks; all in use."""
        self.spark = spark = rows.sparkSession
        bounded_batches(spark)
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        self.width = width = max(1, width or 0)
        sample = sampled(rows, ["id"], FITTED, "hilbert grid").select("vector").toArrow()
        grid = Grid.fit(scaled(padded(sample["vector"].combine_chunks(), width), scale).astype(np.float64))
        vector = rows.schema["vector"].dataType.simpleString()
        block = max(1, min(block, BLOCK_BYTES // (8 * width)))
        parts = max(1, min(CELLS, -(-n // block)), -(-n // SORTED_TOGETHER))
        keyed = rows.mapInArrow(_keyed(grid, width, scale), f"id long, label long, vector {vector}, asks boolean, key binary")
        # Rows that agree in key and id are dealt out by a number of no meaning.
        dealt = keyed.withColumn("salt", F.rand(7)).repartitionByRange(parts, "key", "id", "salt")
        packed = dealt.sortWithinPartitions("key", "id").drop("key", "salt").mapInArrow(_blocked(width, scale, block), _BLOCKS)
        cell = (F.spark_partition_id() / -(-parts // CELLS)).cast("int")
        self.folder = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
        # Small row groups: a task may read part of a file.
        writer = packed.withColumn("cell", cell).write.option("parquet.block.size", 16 << 20)
        writer.partitionBy("cell").parquet(f"{self.folder}/blocks")
        self.table = spark.read.schema(f"{_BLOCKS}, cell int").parquet(f"{self.folder}/blocks")
        some = self.table.where(F.exists("asks", lambda a: a))
        anchors = some.mapInArrow(_anchors, "cell int, id long, label long, vector array<long>")
        anchors.write.partitionBy("cell").parquet(f"{self.folder}/anchors")
        self.anchors = spark.read.schema("id long, label long, vector array<long>, cell int").parquet(f"{self.folder}/anchors")

    def chunks(self, most: int) -> Iterator[tuple[list[int], pa.Table]]:
        """Anchors of neighbouring cells, about ``most`` at once, with their cells."""
        by_cell = {r["cell"]: r["count"] for r in self.anchors.groupBy("cell").count().collect()}
        groups: list[list[int]] = []
        room = 0
        for cell in sorted(by_cell):
            if by_cell[cell] > room:
                groups.append([])
                room = most
            groups[-1].append(cell)
            room -= by_cell[cell]
        for cells in groups:
            mine = self.anchors.where(F.col("cell").isin(cells))
            parts = -(-sum(by_cell[c] for c in cells) // most)
            for part in range(parts):
                yield cells, mine.where(F.pmod(F.xxhash64("id", "vector"), F.lit(parts)) == part).select("id", "label", "vector").toArrow()

    def best(self, asked: Asked, home: Iterable[int]) -> DataFrame:
        """(anchor, window, id, score): the best of every window over all blocks, at most k."""
        home = sorted(home)
        near = self._top([self._search(asked, self.table.where(F.col("cell").isin(home)))], asked.k).toArrow()
        first = np.full((*asked.low.shape, asked.k), NONE)
        anchor, window, place = (near[c].to_numpy() for c in ("anchor", "window", "place"))
        first[anchor, window, place - 1] = near["score"].to_numpy()
        raised = _own_copy(asked)
        raised.low = np.maximum(asked.low, first[:, :, -1])
        sent = self.spark.sparkContext.broadcast(raised)
        reached = self.table.where(~F.col("cell").isin(home)).select("cell", "low", "high").mapInArrow(_reached(sent), "cell int")
        further = sorted(r["cell"] for r in reached.distinct().collect())
        sent.unpersist()
        found = [self.spark.createDataFrame(near.drop_columns("place"))]
        if further:
            found.append(self._search(raised, self.table.where(F.col("cell").isin(further))))
        return self._top(found, asked.k)

    def _search(self, asked: Asked, blocks: DataFrame) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(asked)
        return blocks.drop("asks", "cell").mapInArrow(_searched(sent), "anchor int, window int, id long, score long")

    def _top(self, found: list[DataFrame], k: int) -> DataFrame:
        every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(
    df: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    scale: float = 256,
    anchors_at_once: int = ANCHORS_AT_ONCE,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its best rows of the same label: the best rows of other labels
    whose score lies between the two shares of the positive's score.
    """
    vector = F.col(vector_col)

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        vector.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    ).where("id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(F.forall("vector", finite), F.lit(False)))
    spark = df.sparkSession
    blocks = Blocks(rows, scale, block)
    folder = f"{blocks.folder}/found"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for cells, chunk in blocks.chunks(max(1, min(anchors_at_once, ANCHOR_BYTES // (8 * blocks.width)))):
        ids, labels = chunk["id"].to_numpy(), chunk["label"].to_numpy()
        if not len(ids):
            continue
        vectors = chunk["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        everything = np.full((len(ids), 1), NONE), np.full((len(ids), 1), MOST)
        near = blocks.best(Asked(ids, labels, vectors, *everything, True, positives), cells).toArrow()
        # At most anchors_at_once x positives rows.
        low = np.full((len(ids), positives), MOST)
        high = np.full((len(ids), positives), NONE)
        at = near["anchor"].to_numpy(), near["place"].to_numpy() - 1
        scores = [int(s) for s in near["score"].to_pylist()]
        low[at] = [-(-least_percent * s // 100) for s in scores]
        high[at] = [most_percent * s // 100 for s in scores]
        positive = spark.createDataFrame(
            pa.table(
                {
                    "anchor": near["anchor"],
                    "window": pa.array(at[1].astype(np.int32)),
                    "anchor_id": pa.array(ids[at[0]]),
                    "positive_id": near["id"],
                    "positive_score": near["score"],
                }
            )
        )
        hard = blocks.best(Asked(ids, labels, vectors, low, high, False, negatives), cells)
        hard.join(positive, ["anchor", "window"]).select(
            "anchor_id",
            "positive_id",
            F.col("place").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
