"""Near-duplicates by SimHash fingerprints and by the exact resemblance of word shingles.

Fingerprints are linked as ``simhash`` does it: all pairs at a few differing bits or fewer.
Near copies beyond that are linked by resemblance, found through MinHash bands: a text is the set of its shingles (hashes of ``words`` neighbouring words); texts of one
set are one node. ``BANDS`` times ``ROWS`` least values under different orders make a
node's band keys, and nodes that share a key are compared: the resemblance (Jaccard) of
their whole sets is computed exactly, and a bucket returns a tree for each connected part,
at most one link for each member. A pair of resemblance s shares a key with probability
``1 - (1 - s**ROWS)**BANDS``: 0.998 at 0.8, 0.99999 at 0.9.

Buckets with the same members are compared once. Buckets above ``BLOCK`` members are split
into blocks, and every two blocks are one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smudgelab.llm import components, simhash
from smudgelab.llm.common import bounded_batches, stored, whole_texts, without

#: Bands, and least values in each.
BANDS, ROWS = 12, 4
#: Members of a bucket that one task compares; a larger bucket is split.
BLOCK = 512

_draw = np.random.default_rng(8)
_FACTOR = _draw.integers(0, 2**64, size=(BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_SHIFT = _draw.integers(0, 2**64, size=(BANDS * ROWS, 1), dtype=np.uint64)


def shingles_of(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. No word: none."""
    found = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        parts = [joined]
    else:
        ends = list(accumulate(len(w) + 1 for w in found))
        parts = [joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, seed) for s in parts], dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """The (signed) key of each band. No shingle: no key."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for part in range(0, len(shingles), 4096):
        ordered = shingles[part : part + 4096] * _FACTOR + _SHIFT
        least = np.minimum(least, ordered.min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _with_nodes(df: DataFrame, text_col: str, words: int, seed: int) -> DataFrame:
    """``df`` with ``_fingerprint``, the digest of the shingle set, and ``_bands``."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("struct<node:long,bands:array<long>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            nodes, bands = [], []
            for text in batch:
                shingles = shingles_of(text.as_py(), words, seed)
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes()))
                bands.append(band_keys(shingles))
            nodes = np.array(nodes, dtype=np.uint64).view(np.int64)
            yield pa.StructArray.from_arrays(
                [pa.array(nodes), pa.array(bands, type=pa.list_(pa.int64()))], ["node", "bands"]
            )

    df = without(df, "_fingerprint", "_bands")
    found = df.withColumn("_of", of(whole_texts(df[text_col])))
    return found.select(*df.columns, F.col("_of.node").alias("_fingerprint"), F.col("_of.bands").alias("_bands"))


def _shingled(df: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, shingles as bytes) of rows (node, text)."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles_of(t.as_py(), words, seed).tobytes() for t in batch], type=pa.binary())

    return df.select("node", of(whole_texts(df["text"])).alias("shingles"))


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places (a, b) of sets, linked so that they connect what chains of resemblance
    ``least`` or more connect. Visits a part breadth first, as ``simhash.forest`` does."""
    sizes = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            own = sets[queue.pop()]
            # Neither set may be too small for the resemblance at all.
            ratio = np.minimum(sizes[left], len(own)) / np.maximum(sizes[left], len(own))
            able = np.flatnonzero(ratio >= least)
            if not len(able):
                continue
            others = left[able]
            every = np.concatenate([sets[k] for k in others])
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            starts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
            shared = np.add.reduceat((own[at] == every).astype(np.int64), starts)
            near = able[shared >= least * (sizes[others] + len(own) - shared) - 1e-9]
            if len(near):
                out += [(int(root), int(k)) for k in left[near]]
                queue.extend(left[near].tolist())
                left = np.delete(left, near)
    return out


def _compared(least: float):
    """Compares the members of each bucket; buckets come sorted, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, nodes, sets = None, [], []

        def links() -> tuple[list[int], list[int]]:
            found = forest(sets, least) if len(sets) > 1 else []
            return [nodes[a] for a, _ in found], [nodes[b] for _, b in found]

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("band", "i", "j", "node")], strict=True)
            start, end = [], []
            for (*key, node), shingles in zip(keys, batch.column("shingles"), strict=True):
                if key != open_key:
                    a, b = links()
                    start += a
                    end += b
                    open_key, nodes, sets = key, [], []
                nodes.append(node)
                # A copy: the batch is not kept for one of its rows.
                sets.append(np.frombuffer(shingles.as_py(), dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["a", "b"])
        a, b = links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _links(texts: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, seed: int, least: float, block: int) -> DataFrame:
    """Links (a, b) between nodes, from all buckets of two members or more."""
    filed = nodes.select("node", F.explode("bands").alias("band")).distinct()
    shared = filed.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit("again"))).alias("y"),
    )
    # Buckets of the same members, told by count and digests, are one.
    buckets = stored(
        shared.where("n > 1").groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "buckets"
    )
    members = stored(filed.join(buckets, "band").select("band", "n", "node"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node")
    # By id and node, as a group of copies has one node.
    match = (texts["_fingerprint"] == wanted["node"]) & texts[id_col].eqNullSafe(wanted["first.id"])
    chosen = texts.join(wanted, match).select("node", F.col(text_col).alias("text"))
    sets = _shingled(chosen, words, seed).groupBy("node").agg(F.first("shingles").alias("shingles"))
    blocks = F.ceil(F.col("n") * 2 / block).cast("int")
    pairs = F.when(F.col("n") <= block, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")),
            lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")),
        )
    )
    dealt = (
        members.join(sets, "node")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
        .select("band", "node", "shingles", F.explode(pairs).alias("p"))
        .select("band", "p.i", "p.j", "node", "shingles")
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
    )
    return dealt.mapInArrow(_compared(least), "a long, b long")


def _fingerprint_links(texts: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of nodes to their SimHash fingerprints, and of fingerprints at ``distance`` or fewer bits.

    Fingerprints take part as nodes under a digest of their own. One that no second node has and
    that is linked to none connects nothing and is left out.
    """
    filed = stored(
        texts.select(F.col("_fingerprint").alias("node"), F.col("_simhash").alias("fingerprint")).distinct(), "filed"
    )
    counted = stored(filed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    near = stored(simhash.links(counted.select("fingerprint"), distance), "fingerprint-links")
    ends = near.select(F.explode(F.array("a", "b")).alias("fingerprint"))
    wanted = counted.where("n > 1").select("fingerprint").unionByName(ends).distinct()

    def as_node(fingerprint: str):
        return F.xxhash64(fingerprint, F.lit("fingerprint"))

    held = filed.join(wanted, "fingerprint", "left_semi").select(F.col("node").alias("a"), as_node("fingerprint").alias("b"))
    return held.unionByName(near.select(as_node("a").alias("a"), as_node("b").alias("b")))


def first_of_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    least: float = 0.8,
    seed: int = 42,
    block: int = BLOCK,
    distance: int = 4,
) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates, with its own columns.

    A group is what chains of texts connect whose SimHash fingerprints (``simhash``, its own
    shingles) differ in ``distance`` or fewer bits, or whose shingle sets resemble each other by
    ``least`` or more. Texts without a word are one group. Ids of null come after all others.
    """
    marked = simhash.fingerprints(df, text_col, "_simhash", seed=seed)
    texts = stored(_with_nodes(marked, text_col, words, seed), "with-bands")
    rows = texts.groupBy(
        F.col("_fingerprint").alias("node"), F.col("_bands").alias("bands"), F.col(id_col).alias("id")
    ).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    nodes = stored(rows.groupBy("node", "bands").agg(first.alias("first")), "nodes")
    alike = _links(texts, nodes, id_col, text_col, words, seed, least, block)
    links = stored(alike.unionByName(_fingerprint_links(texts, distance)), "links")
    root_of = components.roots(links).withColumnRenamed("node", "_node")
    placed = nodes.join(root_of, nodes["node"] == root_of["_node"], "left").select(
        F.col("first.id").alias("id"),
        F.col("node").alias("fingerprint"),
        F.coalesce("root", "node").alias("component"),
        F.col("first.n").alias("n"),
    )
    return simhash.rows_of_firsts(texts, placed, id_col, df.columns)
