"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words (``targets``): shares in proportion to its
weight, none above ``most`` times the source's own size, the excess reshared. A document
then is wanted ``target / source size`` times. The whole part of that are certain copies;
the rest is its inclusion probability p in a sample of fixed size. Pareto order sampling
ranks documents by their random odds ``u / (1 - u)`` divided by the odds ``p / (1 - p)`` and
takes them in this order until the words still wanted are reached; the document at the
border is taken if that comes nearer. u comes from a digest of the id, so reruns agree.

No source is sorted as a whole. Ranks are counted per source in cells of equal
probability (pre-aggregated, at most ``CELLS`` per source); running totals over cells
give the one cell where the border lies, which is cut into cells again (``LEVELS`` times).
Only the documents of the last one, a millionth of a source, are put in order.

Defined results: null texts have size 0; a source of null is a source of its own, last in
order; documents with the same source, id and size rank alike and are taken
alike; null ids take part. Sources without words have target 0. Tables may be empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import WORD_PATTERN, stored, without

#: Cells that ranks of a source are counted in, and how often the border's is cut again.
CELLS = 1024
LEVELS = 2
#: Digits (hexadecimal) of the digest that make the random number; 13 fit a double exactly.
DIGITS = 13


def word_count(text: Column) -> Column:
    """Words of a whole text: runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(id_: Column, seed: str) -> Column:
    """A number above 0 and below 1 from the id's digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") + 0.5) / float(16**DIGITS)


def targets(
    sizes: DataFrame, weights: Sequence[float], total_share: float, most: float
) -> DataFrame:
    """(source, source_size) with each source's target, in words.

    Sources by code point, null last, have the weights in turn. The level of the
    shares rises until the total is spent; a source stops at ``most`` times its size.
    This has one row per source; its windows run over sources only.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ordered = sizes.withColumn(
        "weight", F.get(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    ).withColumn("most", F.col("source_size") * F.lit(float(most)))
    # Sources that stop early come first: those with the lowest level most / weight.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = F.sum("source_size").over(everything) * F.lit(float(total_share)) - F.coalesce(
        F.sum("most").over(below), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(below), F.lit(0.0)
    )
    # The level if this source and all later ones were open; it holds from the first
    # source on that doesn't stop at it.
    levels = ordered.withColumn("level", left / open_weight)
    holds = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    level = F.first(holds, ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return levels.select(
        "source",
        "source_size",
        F.coalesce(F.least("most", level * F.col("weight")), "most").alias("target"),
    )


def mix(
    df: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total_share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    docs = stored(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            uniform(F.col(id_col), seed).alias("u"),
        ),
        "sizes",
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = stored(targets(sizes, weights, total_share, most), "targets").withColumn(
        "ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    wanted = wanted.select(
        "source",
        "source_size",
        "target",
        F.floor("ratio").alias("certain"),
        (F.col("ratio") - F.floor("ratio")).alias("p"),
        (F.col("target") - F.floor("ratio") * F.col("source_size")).alias("open_words"),
    )
    odds = F.when(
        F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    )
    ranked = _joined(docs, wanted).select(
        "doc_id", "source", "size", "source_size", "target", "certain", "open_words", "u", odds.alias("rank")
    )
    # Within a source the rank grows with u, so cells of u are cells of the rank.
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    at_border = ranked.where(F.col("rank").isNotNull()).withColumn("before", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        cell = F.floor(F.col("u") * float(CELLS**level))
        cells = at_border.groupBy("source", cell.alias("cell")).agg(
            F.sum("size").alias("words"),
            F.first("open_words").alias("open_words"),
            F.first("before").alias("outside"),
        )
        border = (
            cells.withColumn("before", F.col("outside") + F.coalesce(F.sum("words").over(before), F.lit(0)))
            .where("before < open_words and before + words >= open_words")
            .select("source", "cell", "before")
        )
        border = stored(border, "border")
        at_border = _joined(ranked.where(F.col("rank").isNotNull()), border).where(
            F.floor(F.col("u") * float(CELLS**level)) == F.col("cell")
        )
    # Documents of the border cell in order; equal ones count together.
    same = at_border.groupBy("source", "rank", "doc_id", "size").agg(
        F.sum("size").alias("words"), F.first("before").alias("before"), F.first("open_words").alias("open_words")
    )
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    same = same.withColumn(
        "reached",
        F.col("before") + F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
    ).where("reached >= open_words")
    # The first to reach the wanted words is in if it comes nearer than leaving it out.
    crossing = same.groupBy("source").agg(
        F.min(F.struct("rank", "doc_id", "size", "words", "reached", "open_words")).alias("c")
    )
    stop = stored(
        crossing.select(
            "source",
            F.col("c.rank").alias("stop_rank"),
            F.col("c.doc_id").alias("stop_id"),
            F.col("c.size").alias("stop_size"),
            (
                F.col("c.reached") - F.col("c.open_words")
                <= F.col("c.open_words") - (F.col("c.reached") - F.col("c.words"))
            ).alias("stop_in"),
        ),
        "stops",
    )
    here = F.struct(F.col("rank"), F.col("doc_id"), F.col("size"))
    there = F.struct(F.col("stop_rank"), F.col("stop_id"), F.col("stop_size"))
    extra = F.when(F.col("rank").isNull(), False).otherwise(
        F.when(F.col("stop_rank").isNull(), F.col("open_words") > 0).otherwise(
            (here < there) | ((here == there) & F.col("stop_in"))
        )
    )
    return _joined(ranked, stop, "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("certain") + extra.cast("long")).alias("copies"),
        ((F.col("certain") + extra.cast("long")) * F.col("size")).alias("taken"),
    )


def _joined(left: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Adds what is known of a row's source. The table of sources is small and stored, so
    the planner sees its size and sends it to all executors only if it fits."""
    other = by_source.withColumnRenamed("source", "_source")
    return left.join(other, left["source"].eqNullSafe(other["_source"]), how).drop("_source")


def repeated(df: DataFrame, taken: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` as many times as the mix takes them, with their own columns."""
    counts = (
        taken.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"))
        .agg(F.first("copies").alias("_copies"))
        .where("_copies > 0")
    )
    match = (
        df[id_col].eqNullSafe(counts["_id"])
        & word_count(df["text"]).eqNullSafe(counts["_size"])
        & df["source"].eqNullSafe(counts["_source"])
    )
    return (
        df.join(counts, match)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*df.columns)
    )
