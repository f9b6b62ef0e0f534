"""Quality rules with thresholds that adapt to each language and source.

Each text gets a few counts. The rates they give (symbols, repeated lines, repeated
words, word length) are sketched per language and source: counts of documents per cell of
fixed width. Two such sketches merge by adding counts (so they are pre-aggregated where the
documents lie, and sketches of sources add up to one of their language), and a quantile
read from one is off by a cell at most. Most texts show nothing of most rates, so only those that do
are sketched.

The fences of a group are quantiles of its own sketch (``TAIL`` at the upper end, and at the lower end for
word length), drawn towards those of its language as if ``PRIOR`` more documents of the language lay
there, and these towards those of all documents. Nothing else bounds them: no cutoff is fixed, and a
group of any size counts by its size. A document is kept if none of its rates lies beyond a fence.

Defined results: null texts have no words; a null language or source is a group of its
own; texts that fail the base rules (too short, mostly repeated) are not kept and not
sketched; a rate that no document shows has no fence. Columns of the input that clash with the added ones
are replaced, any others stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import bounded_batches, fresh_name, stored, whole_texts, without

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Base rules: at least so many words, at most this share (in %) of them in repeats.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The quantile that is the upper fence, in percent; its mirror image is the lower one.
TAIL = 99
#: Documents of the larger group that each group's fence is blended with.
PRIOR = 200
#: Rates in cells, and whether low values count.
RATES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", False),
    "lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", False),
    "length": ("least(20 * word_chars div greatest(n_words, 1), 2000)", True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    inside = np.zeros(len(words), dtype=bool)
    at = np.flatnonzero([seen[w] > 1 for w in windows])
    for shift in range(3):
        inside[at + shift] = True
    return int(inside.sum())


def counts_of(text: str) -> tuple[int, ...]:
    """``COUNTS`` of a whole text."""
    words = text.encode().split()  # bytes: ASCII white space only
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts of every whole text and ``base_failed``."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf(f"struct<{','.join(f'{c}:long' for c in COUNTS)}>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [counts_of(text.as_py()) for text in batch]
            columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
            yield pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], list(COUNTS))

    text = df[text_col]
    df = without(df, *COUNTS, "base_failed")
    added = fresh_name(df.columns, "_counts")
    found = df.withColumn(added, counts(whole_texts(text)))
    return found.select(
        *df.columns,
        *[F.col(f"{added}.{c}").alias(c) for c in COUNTS],
    ).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )


def sketches(df: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, rate, cell, n) of the documents that pass the base rules and show a rate."""
    cells = F.array(
        *[F.struct(F.lit(name).alias("rate"), F.expr(rate).alias("cell")) for name, (rate, _) in RATES.items()]
    )
    rows = df.where(~F.col("base_failed")).select(
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(cells).alias("x")
    )
    return rows.where("x.cell > 0").groupBy("lang", "source", "x.rate", "x.cell").agg(F.count(F.lit(1)).alias("n"))


def _tails(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, rate, rows, low, high): quantiles of sketches added up over all other columns."""
    merged = sketch.groupBy(*keys, "rate", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")
    upto = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(group))

    def quantile(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("rows"), F.col("cell")))

    return ranked.groupBy(*keys, "rate").agg(
        F.first("rows").alias("rows"), quantile(100 - TAIL).alias("low"), quantile(TAIL).alias("high")
    )


def _blended(rows: str, own: str, larger: str) -> Column:
    """A group's fence and that of the larger group, weighted by ``rows`` and ``PRIOR``."""
    n = F.coalesce(F.col(rows), F.lit(0))
    mixed = (n * F.coalesce(F.col(own), F.lit(0)) + PRIOR * F.col(larger)) / (n + PRIOR)
    return F.floor(mixed).cast("long")


def thresholds(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per (lang, source) of ``groups``, with its fences: a struct (low, high) per rate."""
    own, overall = _tails(sketch, "lang", "source"), _tails(sketch)
    by_lang = _tails(sketch, "lang")
    rates = F.explode(F.array(*[F.lit(r) for r in RATES])).alias("rate")
    languages = groups.select("lang").distinct().select("lang", rates)
    # A row per rate: four at most.
    every = F.broadcast(overall.select("rate", F.col("low").alias("a_low"), F.col("high").alias("a_high")))
    of_lang = by_lang.select(F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"), "rows", "low", "high")
    joined = languages.join(every, "rate").join(
        of_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")), "left"
    )
    levelled = joined.select(
        F.col("lang").alias("l_lang"),
        "rate",
        _blended("rows", "low", "a_low").alias("l_low"),
        _blended("rows", "high", "a_high").alias("l_high"),
    )
    of_group = own.select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.col("rate").alias("g_rate"), "rows", "low", "high"
    )
    found = (
        groups.select("lang", "source").distinct()
        .join(levelled, F.col("lang").eqNullSafe(F.col("l_lang")))
        .join(
            of_group,
            F.col("lang").eqNullSafe(F.col("g_lang"))
            & F.col("source").eqNullSafe(F.col("g_source"))
            & (F.col("rate") == F.col("g_rate")),
            "left",
        )
    )
    fences = F.struct(_blended("rows", "low", "l_low").alias("low"), _blended("rows", "high", "l_high").alias("high"))
    by_rate = [F.first(F.when(F.col("rate") == r, fences), ignorenulls=True).alias(r) for r in RATES]
    return found.groupBy("lang", "source").agg(*by_rate)


def judged(df: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``df`` (counted, stored) with ``kept``: within all fences of its language and source."""
    df = without(df, "kept")
    groups = df.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source")).distinct()
    # A row per language and source, stored: the planner knows its size before it joins.
    limits = stored(thresholds(sketches(df, lang_col, source_col), groups), "thresholds")
    names = {c: fresh_name(df.columns, f"fence_{c}") for c in limits.columns}
    limits = limits.select(*[F.col(c).alias(n) for c, n in names.items()])
    within = F.lit(True)
    for name, (rate, two_sided) in RATES.items():
        within &= F.coalesce(F.expr(rate) <= F.col(f"{names[name]}.high"), F.lit(True))
        if two_sided:
            within &= F.coalesce(F.expr(rate) >= F.col(f"{names[name]}.low"), F.lit(True))
    match = df[lang_col].eqNullSafe(limits[names["lang"]]) & df[source_col].eqNullSafe(limits[names["source"]])
    return df.join(limits, match, "left").select(*df.columns, (~F.col("base_failed") & within).alias("kept"))
