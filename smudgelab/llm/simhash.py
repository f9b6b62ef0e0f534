"""Near-duplicates by SimHash fingerprints and a generalised pigeonhole search.

A fingerprint has 64 bits. Its bits are split into partitions of bits that vary
together, and partition i gets a threshold t_i, -1 (not probed) or more, so that
``sum(t_i + 1) = distance + 1``: two fingerprints that differ in at most ``distance`` bits
then differ in at most t_i bits of some partition i. How many partitions there are and
how the thresholds are dealt out is found by dynamic programming on the candidate
counts that a bounded sample of fingerprints lets expect; the sample steers the cost
only, never the result.

A fingerprint is filed under its bits in partition i with every choice of t_i bits
masked out. Fingerprints in one file (a bucket) are compared exactly and a bucket
returns a tree for each connected part, at most one link for each member, so links
grow with the members. Buckets above ``BLOCK`` members are split into blocks, and every two
blocks are one task. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab.llm import components
from smudgelab.llm.common import bounded_batches, sampled, stored, whole_texts, without

BITS = 64
#: Members of a bucket that one task compares; a larger bucket is split.
BLOCK = 2048
#: Fingerprints that the search plan looks at (they steer its cost, not its result).
PLANNED_ON = 2048
#: Cost of a shuffled row and of a comparison, in the same unit.
ROW_COST, PAIR_COST = 1.0, 0.01


def fingerprint_of(text: str, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned. No word: 0."""
    found = text.encode().lower().split()  # bytes: ASCII letters and white space only
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    if n <= words:
        shingles = [joined]
    else:
        ends = list(accumulate(len(w) + 1 for w in found))
        shingles = [
            joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :], strict=False)
        ]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype=">u8")
    set_in = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes)).view(">u8")[0])


def fingerprints(
    df: DataFrame, text_col: str = "text", to: str = "fingerprint", words: int = 4, seed: int = 42
) -> DataFrame:
    """``df`` with the fingerprint of every whole text as a (signed) long. Null: as empty."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = [fingerprint_of(text.as_py(), words, seed) for text in batch]
            yield pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return without(df, to).withColumn(to, of(whole_texts(df[text_col])))


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


@dataclass(frozen=True)
class Plan:
    """Partitions (as bit masks) and their thresholds; -1 is not probed."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]

    def kept_bits(self) -> list[int]:
        """The bits to compare for each file a fingerprint goes to."""
        out = []
        for mask, t in zip(self.masks, self.thresholds, strict=True):
            ones = [1 << b for b in range(BITS) if mask >> b & 1]
            if t >= 0:
                out += [mask & ~sum(off) for off in combinations(ones, t)]
        return out


def _groups(sample: np.ndarray, parts: int) -> tuple[int, ...]:
    """Masks of ``parts`` groups of bits; bits that vary together share a group."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    alike = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(alike, 0)
    free, masks = set(range(BITS)), []
    for part in range(parts):
        room = (BITS - part - 1) // parts + 1
        first = max(free, key=lambda b: (alike[b, list(free)].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < room:
            best = max(free, key=lambda b: (alike[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        masks.append(sum(1 << b for b in group))
    return tuple(masks)


def plan_search(sample: np.ndarray, n: int, distance: int) -> Plan:
    """The cheapest plan for ``n`` fingerprints like those of the sample (unsigned)."""
    sample = np.unique(sample.astype(np.uint64)) if len(sample) else np.zeros(1, dtype=np.uint64)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    differ = np.concatenate([sample[i] ^ sample[i + 1 :] for i in range(len(sample))])
    best: tuple[float, Plan] | None = None
    for parts in range(max(1, distance // 2), min(2 * distance + 2, BITS) + 1):
        masks = _groups(sample, parts)
        # cost[p][u]: with threshold u - 1; rank by least[u] over the partitions so far.
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for mask in masks:
            apart = np.bitwise_count(differ & np.uint64(mask))
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for units in range(min(distance + 1, 3) + 1):
                t, cost = units - 1, 0.0
                if units:
                    files = comb(mask.bit_count(), t)
                    close = ((apart <= t).sum() + 1) / (pairs + 1)
                    # Few or no pairs seen: at least what even bits would give.
                    even = sum(comb(mask.bit_count(), k) for k in range(units)) / 2.0 ** mask.bit_count()
                    cost = ROW_COST * n * files + PAIR_COST * n * n / 2 * max(close, even)
                for spent, (so_far, chosen) in least.items():
                    total = spent + units
                    if total <= distance + 1:
                        new = (so_far + cost, (*chosen, t))
                        if total not in following or new < following[total]:
                            following[total] = new
            least = following
        if distance + 1 in least:
            cost, thresholds = least[distance + 1]
            if best is None or cost < best[0]:
                best = (cost, Plan(masks, thresholds))
    if best is None:
        raise ValueError(f"no plan for distance {distance}")
    return best[1]


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what chains of at most ``distance`` differing bits connect.

    Visits a part breadth first; a value is compared with those not reached yet only,
    so a bucket of near copies costs little more than one pass.
    """
    n = len(values)
    if n <= 256:
        close = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
        if not np.triu(close, 1).any():
            return values[:0], values[:0]
    left, start, end = values, [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                reached = left[near]
                left = left[~near]
                queue.extend(reached)
                start.append(np.full(len(reached), root))
                end.append(reached)
    if not start:
        return values[:0], values[:0]
    return np.concatenate(start), np.concatenate(end)


def _compared(distance: int):
    """Compares the members of each bucket; buckets come sorted, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_values = None, []

        def links(key_values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate(key_values).view(np.uint64)
            return forest(values, distance) if len(values) > 1 else (values[:0], values[:0])

        def batch_of(found: list) -> pa.RecordBatch:
            a = np.concatenate([x for x, _ in found]).view(np.int64)
            b = np.concatenate([y for _, y in found]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("file", "i", "j")]
            values = batch.column("fingerprint").to_numpy()
            if not len(values):
                continue
            new = np.zeros(len(values), dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(values)]
            found = []
            for at, to in zip(cuts, cuts[1:], strict=False):
                key = tuple(k[at] for k in keys)
                if key != open_key:
                    if open_values:
                        found.append(links(open_values))
                    open_key, open_values = key, []
                open_values.append(values[at:to])
            if found:
                yield batch_of(found)
        if open_values:
            yield batch_of([links(open_values)])

    return run


def links(nodes: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct values of ``nodes.fingerprint``.

    Two fingerprints are connected by the returned links exactly if a chain of
    fingerprints leads from one to the other in steps of ``distance`` bits or fewer.
    """
    sample = [r[0] for r in sampled(nodes.select("fingerprint"), ["fingerprint"], PLANNED_ON, "plan").collect()]
    plan = plan_search(np.array(sample, dtype=np.int64).view(np.uint64), nodes.count(), distance)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in plan.kept_bits()]
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(signed)])
    filed = nodes.select("fingerprint", F.explode(masks).alias("mask")).select(
        F.xxhash64("mask.k", F.col("fingerprint").bitwiseAND(F.col("mask.m"))).alias("file"),
        "fingerprint",
    )
    large = stored(
        filed.groupBy("file").count().where(F.col("count") > block)
        .select("file", F.ceil(F.col("count") * 2 / block).cast("int").alias("blocks")),
        "large-buckets",
    )
    own = F.pmod(F.xxhash64("fingerprint", F.lit("block")), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")),
            lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")),
        )
    )
    dealt = (
        filed.join(large, "file", "left")
        .withColumn("own", own)
        .select("file", "fingerprint", F.explode(pairs).alias("p"))
        .select("file", "p.i", "p.j", "fingerprint")
        .repartition("file", "i", "j")
        .sortWithinPartitions("file", "i", "j")
    )
    return dealt.mapInArrow(_compared(distance), "a long, b long")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    fingerprint_col: str = "fingerprint",
    distance: int = 4,
    block: int = BLOCK,
) -> DataFrame:
    """``df`` (ids and fingerprints, stored) with ``component_id`` and ``component``.

    ``component`` is the smallest (signed) fingerprint of the group.

    The smallest id that chains of fingerprints at ``distance`` or fewer differing bits
    reach. Rows of empty texts have fingerprint 0 and are linked like others. Null ids are
    members but never a component's id, unless it has no other (then it is null).
    """
    df = without(df, "component_id", "component")
    nodes = stored(
        df.groupBy(F.col(fingerprint_col).alias("fingerprint")).agg(F.min(id_col).alias("least")),
        "fingerprints",
    )
    root_of = components.roots(stored(links(nodes, distance, block), "links"))
    placed = nodes.join(root_of, nodes["fingerprint"] == root_of["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stored(placed.join(named, "root").select("fingerprint", "component_id", F.col("root").alias("component")), "components")
    ids = ids.withColumnRenamed("fingerprint", "_fingerprint")
    joined = df.join(ids, df[fingerprint_col] == ids["_fingerprint"], "left")
    return joined.drop("_fingerprint")


def first_of_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    seed: int = 42,
    distance: int = 4,
) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates, with its own columns.

    Ids of null come after all others. Of rows that share id and fingerprint, the
    smallest by all columns stays.
    """
    texts = stored(fingerprints(df, text_col, "_fingerprint", words, seed), "with-fingerprints")
    ids = texts.select(F.col(id_col).alias("id"), F.col("_fingerprint").alias("fingerprint"))
    grouped = near_duplicates(ids, "id", "fingerprint", distance)
    counted = grouped.groupBy("component", "id", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return rows_of_firsts(texts, counted, id_col, df.columns)


def rows_of_firsts(texts: DataFrame, counted: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The row of ``texts`` that comes first in each component, with ``columns``.

    ``counted`` has (component, id, fingerprint, n), n the rows that share id and fingerprint;
    of each fingerprint the smallest id is enough.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "fingerprint")
    first = counted.groupBy("component").agg(F.min_by(F.struct("id", "fingerprint", "n"), rank).alias("f"))
    first = stored(
        first.select(F.col("f.id").alias("_id"), F.col("f.fingerprint").alias("_value"), F.col("f.n").alias("_n")),
        "first-of-groups",
    )
    match = (texts["_fingerprint"] == first["_value"]) & texts[id_col].eqNullSafe(first["_id"])
    kept = texts.join(first, match)
    single = kept.where("_n = 1").select(*columns)
    if first.where("_n > 1").isEmpty():
        return single
    row = F.struct(*columns)
    repeated = kept.where("_n > 1").groupBy("_fingerprint", "_id").agg(F.min(row).alias("row"))
    return single.unionByName(repeated.select("row.*"))
