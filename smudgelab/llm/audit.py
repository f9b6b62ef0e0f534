"""How filters interact: what each removes in every order they may be applied in.

Each document has a mask of the filters it fails. A mask decides all that happens to the
document: in every order and at every step it is kept, removed here, or gone already. These
outcomes stand side by side in one big integer per mask, a field of ``FIELD_BITS`` for each
order, step and measure. The integers of a part's documents are added up, and the sum
holds every count of the part: no field can run over into the next, since a field counts
at most the documents of the part, which a long holds. Equal masks are counted first, where the
documents lie, so a part adds one product per kind of mask, however many documents it has.

Being a copy of an earlier document is the one filter that looks beyond the document. Rows
are grouped by digest, id and mask, then the rows of the smallest id are picked per digest
(the pick starts before the shuffle), so a text that a third of all rows share is no hot key.

Defined results: a null text is the empty one; a null part is the empty string; a null id is
neither a copy nor an original, and has no labels; rows that repeat an id all count, and are no
copies of each other; labels that repeat an id hold if one of them does; an empty table gives no
rows. The input's own columns never clash: only those named are read, under new names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import stored, whole_texts

#: Bits of a counter; as wide as a count of rows.
FIELD_BITS = 64
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Settings of the filters of the whole text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"


@lru_cache(maxsize=8)
def steps(letters: str) -> tuple[tuple[str, int], ...]:
    """(order, step) of each block of fields, in the order of the fields."""
    return tuple(("".join(p), s + 1) for p in permutations(letters) for s in range(len(letters)))


@lru_cache(maxsize=4096)
def packed(letters: str, mask: int, good: bool, toxic: bool) -> int:
    """All outcomes of one document as one integer; bit k of the mask is letter k."""
    fields = np.zeros((len(steps(letters)), len(MEASURES)), dtype="<u8")
    for row, (order, step) in zip(fields, steps(letters), strict=True):
        fails = [mask >> letters.index(f) & 1 for f in order[:step]]
        here, gone = fails[-1], any(fails[:-1])
        lost = here and not gone
        row[:] = (
            not here and not gone,
            lost,
            here and gone,
            mask == 1 << letters.index(order[step - 1]),
            lost and good,
            lost and toxic,
        )
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(letters: str, total: int) -> np.ndarray:
    """(steps, measures) counts of a sum of packed integers."""
    shape = len(steps(letters)), len(MEASURES)
    raw = total.to_bytes(shape[0] * shape[1] * FIELD_BITS // 8, "little")
    return np.frombuffer(raw, dtype="<u8").astype(np.int64).reshape(shape)


def text_failures(text: Column, words: Column) -> list[Column]:
    """Conditions A to D over a text and its words."""
    n_words = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n_words < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n_words,
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    ]


#: Makes conditions from a text and its words; their letters are A, B, ...
Conditions = Callable[[Column, Column], list[Column]]


def masked(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    conditions: Conditions = text_failures,
) -> DataFrame:
    """(id, part, digest, mask, n): rows that agree in all of these, with their number."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        whole_texts(F.col(text_col)).alias("text"),
    ).withColumn("words", words)
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions(F.col("text"), F.col("words")))]
    rows = texts.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    return rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str, good_col: str, toxic_col: str) -> DataFrame:
    """``rows`` with what the labels say about their ids; false where they say nothing."""
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic"),
    )
    joined = rows.join(told, "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_counts(rows: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, good, toxic, n) with the copy filter in the mask.

    All rows count as copies first; then those with the smallest id of their digest, and
    those without an id, are moved to the mask without that bit.
    """
    kind = ["part", "mask", "good", "toxic"]
    earliest = Window.partitionBy("digest").orderBy("id")
    originals = (
        rows.where(F.col("id").isNotNull())
        .withColumn("place", F.rank().over(earliest))
        .where(F.col("place") == 1)
        .select(*kind, "n")
        .unionByName(rows.where(F.col("id").isNull()).select(*kind, "n"))
    )
    copy = (F.col("mask") + F.lit(copy_bit)).alias("mask")
    moved = [
        rows.select("part", copy, "good", "toxic", "n"),
        originals.select("part", copy, "good", "toxic", (-F.col("n")).alias("n")),
        originals,
    ]
    every = reduce(DataFrame.unionByName, moved)
    return every.groupBy(*kind).agg(F.sum("n").alias("n"))


def outcomes(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, measures, shapley) of counted masks; n! x n rows a part."""
    columns = ["part", "filter_order", "step", *MEASURES, "shapley"]
    kinds = ["string", "string", "int", *["long"] * (len(MEASURES) + 1)]

    def summed(rows: pa.Table) -> pa.Table:
        total = 0
        for row in rows.to_pylist():
            total += row["n"] * packed(letters, row["mask"], row["good"], row["toxic"])
        fields = unpacked(letters, total)
        orders, places = zip(*steps(letters), strict=True)
        own = np.array([letters.index(o[s - 1]) for o, s in steps(letters)])
        removed = fields[:, MEASURES.index("removed")]
        shapley = np.array([removed[own == k].sum() for k in range(len(letters))])[own]
        values = [
            pa.array([rows["part"][0].as_py()] * len(own), pa.string()),
            pa.array(orders),
            pa.array(places, pa.int32()),
            *[pa.array(fields[:, k]) for k in range(len(MEASURES))],
            pa.array(shapley),
        ]
        return pa.table(values, names=columns)

    schema = ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True))
    return counts.groupBy("part").applyInArrow(summed, schema)


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: Conditions = text_failures,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    good_col: str = "quality",
    toxic_col: str = "toxic",
) -> DataFrame:
    """What each filter removes, per part, order and step; see ``outcomes``.

    The letter after those of the conditions is the copy filter: the text is that of a smaller id.
    """
    n_conditions = len(conditions(F.lit(""), F.array().cast("array<string>")))
    rows = masked(docs, id_col, text_col, part_col, conditions)
    rows = stored(with_labels(rows, labels, id_col, good_col, toxic_col), "filter-masks")
    return outcomes(mask_counts(rows, 1 << n_conditions), ascii_uppercase[: n_conditions + 1])
