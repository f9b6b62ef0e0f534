"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of three rows of a hashed table: of the word and of its
first four and five letters (so unseen forms of a known stem are near it). Filters of
several widths run over the words of a whole text, each keeps its largest response (max
pooling), and a logistic layer gives the logit. All of it is trained in numpy on a
bounded, documented sample of labelled rows, drawn evenly over languages.

Thresholds by language come from all labelled rows that did not teach: histograms of their logits by
language and label, which merge by adding counts. A language's cut gets the least shares of both labels
wrong over its own rows and, as if ``PRIOR`` more rows lay there, those of all languages; so it counts by its size, and one
without rows has the cut of all. Scores are shifted so that 0.5 is the cut. The language is read from the text: word
counts of the sample, by language, in the same hashed rows. Language columns are never an input.

Prediction is one pass without a shuffle; long texts go through the filters in parts of
bounded size.

Defined results: null and empty texts are a text of no words and get the score of one. Labels of
null teach nothing; of a repeated id the highest label counts, and its smallest text teaches. Without labels of
both kinds every score is 0. Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import bounded_batches, fresh_name, whole_texts, without

#: Labelled rows that training looks at, per label, and characters of their texts in all.
ROWS_PER_LABEL, LEAST_ROWS, SAMPLE_CHARS = 2000, 20, 48_000_000
#: Rows and width of the embedding table; filter widths (in words) and filters of each.
BUCKETS, WIDTH = 1 << 15, 16
FILTER_WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, RATE = 3, np.float32(0.05)
#: Words that go through the filters at once, and words that a worker remembers.
PART, KEPT = 1 << 15, 200_000
#: One row in so many never teaches, so that thresholds have rows to look at.
KEPT_OUT = 10
#: Rows of all languages that each language's threshold is blended with; logits are counted within
#: +-END in cells of this width.
PRIOR, END, CELL = 100, 30.0, 0.05
#: The logit where nothing was learned.
NEVER = -700.0
_WORDS = re.compile(r"\w+").findall


class _Rows(dict):
    """Numbers words; the hashed rows of word i are ``self.hashed[i]``."""

    def __init__(self) -> None:
        super().__init__()
        self.hashed = np.zeros((1 << 12, 3), dtype=np.int32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hashed):
            self.hashed = np.concatenate((self.hashed, np.zeros_like(self.hashed)))
        self.hashed[at] = [
            zlib.crc32(part.encode(), seed) % BUCKETS for seed, part in enumerate((word, word[:4], word[:5]))
        ]
        self[word] = at
        return at


_known = _Rows()


def hashed_words(text: str) -> np.ndarray:
    """(words, 3) table rows of a whole text."""
    global _known
    if len(_known) > KEPT:
        _known = _Rows()
    at = list(map(_known.__getitem__, _WORDS(text.lower())))
    return _known.hashed[np.array(at, dtype=np.int64)]


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: tuple[str, ...]
    words: np.ndarray  # log-likelihood of a word's row by language
    taught: tuple = ()  # ids of the rows that taught

    def responses(self, rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Largest response of each filter, and the word at which it starts."""
        best = [np.full(FILTERS, -np.inf, dtype=np.float32) for _ in FILTER_WIDTHS]
        where = [np.zeros(FILTERS, dtype=np.int64) for _ in FILTER_WIDTHS]
        widest = max(FILTER_WIDTHS)
        n = max(1, len(rows))
        for start in range(0, n, PART):
            stop = min(n, start + PART)
            part = rows[start : stop + widest - 1]
            x = np.zeros((stop - start + widest - 1, WIDTH), dtype=np.float32)
            x[: len(part)] = self.table[part].sum(axis=1)
            for k, width in enumerate(FILTER_WIDTHS):
                wide = np.concatenate([x[i : i + stop - start] for i in range(width)], axis=1)
                given = wide @ self.filters[k]
                at = given.argmax(axis=0)
                top = given[at, np.arange(FILTERS)]
                better = top > best[k]
                best[k][better] = top[better]
                where[k][better] = at[better] + start
        return best, where

    def logit(self, rows: np.ndarray) -> float:
        best, _ = self.responses(rows)
        pooled = np.maximum(np.concatenate([b + s for b, s in zip(best, self.shift, strict=True)]), 0)
        return float(pooled @ self.out + self.bias)

    def language(self, rows: np.ndarray) -> str:
        if not len(rows) or not self.languages:
            return ""
        total = np.zeros(len(self.languages))
        for start in range(0, len(rows), PART):
            total += self.words[rows[start : start + PART, 0]].sum(axis=0, dtype=np.float64)
        return self.languages[int(total.argmax())]

    def rate(self, text: str) -> tuple[float, str]:
        """Logit and language of a whole text."""
        rows = hashed_words(text)
        return self.logit(rows), self.language(rows)


class _Adaptive:
    """Steps divided by the root of the squared gradients so far."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.seen = values, np.full_like(values, 1e-4)

    def step(self, gradient: np.ndarray, at=slice(None)) -> None:
        self.seen[at] += gradient**2
        self.values[at] -= RATE * gradient / np.sqrt(self.seen[at])


def _network(bags: list[np.ndarray], labels: list[int], seed: int) -> Model:
    rng = np.random.default_rng(seed)

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    model = Model(
        drawn(BUCKETS, WIDTH, scale=0.1),
        [drawn(w * WIDTH, FILTERS, scale=0.2) for w in FILTER_WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in FILTER_WIDTHS],
        drawn(FILTERS * len(FILTER_WIDTHS), scale=0.2),
        0.0,
        (),
        np.zeros((BUCKETS, 0), dtype=np.float32),
    )
    table, out = _Adaptive(model.table), _Adaptive(model.out)
    filters, shift = [_Adaptive(f) for f in model.filters], [_Adaptive(s) for s in model.shift]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rows = bags[i]
            best, where = model.responses(rows)
            raw = np.concatenate([b + s for b, s in zip(best, model.shift, strict=True)])
            pooled = np.maximum(raw, 0)
            z = float(np.clip(pooled @ model.out + model.bias, -30, 30))
            error = np.float32(1 / (1 + np.exp(-z)) - labels[i])
            back = np.where(raw > 0, model.out * error, 0).astype(np.float32)
            out.step(pooled * error)
            model.bias -= float(RATE * error)
            for k, width in enumerate(FILTER_WIDTHS):
                d = back[k * FILTERS : (k + 1) * FILTERS]
                if not d.any():
                    continue
                shift[k].step(d)
                # Only the words at the largest responses move.
                change = np.zeros_like(model.filters[k])
                for f in np.flatnonzero(d):
                    for offset in range(width):
                        at = where[k][f] + offset
                        if at >= len(rows):
                            continue
                        here = slice(offset * WIDTH, (offset + 1) * WIDTH)
                        change[here, f] = d[f] * model.table[rows[at]].sum(axis=0)
                        table.step(
                            np.broadcast_to(d[f] * model.filters[k][here, f], (3, WIDTH)), rows[at]
                        )
                filters[k].step(change)
    return model


def train(texts: list[str], labels: list[int], languages: list[str | None], seed: int = 5) -> Model:
    """A model of texts labelled 0 or 1; it knows languages by their words."""
    bags = [hashed_words(t) for t in texts]
    model = _network(bags, labels, seed)
    names = tuple(sorted(set(languages) - {None}))
    counts = np.zeros((BUCKETS, len(names)))
    for bag, language in zip(bags, languages, strict=True):
        if language is not None:
            np.add.at(counts[:, names.index(language)], bag[:, 0], 1)
    counts += 0.1
    model.languages, model.words = names, np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return model


def known_labels(labels: DataFrame, id_col: str, label_col: str, where: Column | None) -> DataFrame:
    """(id, label): one row per labelled id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known if where is None else known.where(where)
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))


def even_shares(rows: dict, wanted: int) -> dict:
    """How many rows of each key to take: alike for all, what small ones lack goes to the others."""
    taken, left = {}, wanted
    for i, (key, n) in enumerate(sorted(rows.items(), key=lambda pair: (pair[1], pair[0] or ""))):
        taken[key] = min(n, max(LEAST_ROWS, left // (len(rows) - i)))
        left -= taken[key]
    return taken


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    rows_per_label: int = ROWS_PER_LABEL,
    where: Column | None = None,
) -> Model | None:
    """Trains on at most ``rows_per_label`` rows of each label, evenly over languages: those with the
    smallest hashes of their ids. ``where`` (over the labels) leaves rows out. None without both labels."""
    drawn = F.xxhash64("id", F.lit("toxicity sample"))
    known = known_labels(labels, id_col, label_col, where).where(F.pmod(drawn, F.lit(KEPT_OUT)) != 0)
    told = docs.groupBy(F.col(id_col).alias("id")).agg(F.min(lang_col).alias("lang"))
    placed = known.join(told, "id")
    strata = placed.groupBy("label", "lang").agg(F.count(F.lit(1)).alias("rows")).collect()  # a row per label and language
    if {r["label"] for r in strata} != {0, 1}:
        return None
    shares = []
    for y in (0, 1):
        rows_of = {r["lang"]: r["rows"] for r in strata if r["label"] == y}
        for lang, most in even_shares(rows_of, rows_per_label).items():
            shares.append((y, lang, most, min(1.0, (1.5 * most + 50) / rows_of[lang])))
    rates = docs.sparkSession.createDataFrame(shares, "label int, lang string, most int, rate double")
    within = F.row_number().over(Window.partitionBy("label", "lang").orderBy(drawn, "id"))
    matched = (placed["label"] == rates["label"]) & placed["lang"].eqNullSafe(rates["lang"])
    thinned = placed.join(F.broadcast(rates), matched).where(
        F.pmod(F.xxhash64("id", F.lit("toxicity rate")), F.lit(1 << 30)) < F.col("rate") * float(1 << 30)
    ).select("id", placed["label"], placed["lang"], "most")
    sample = thinned.withColumn("place", within).where(F.col("place") <= F.col("most")).select("id", "label")
    # At most rows_per_label (or LEAST_ROWS a language) ids of each label.
    texts = docs.select(F.col(id_col).alias("id"), whole_texts(F.col(text_col)).alias("text"), F.col(lang_col).alias("lang"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min(F.struct("text", "lang")).alias("d"))
    by_hash = Window.partitionBy("label").orderBy(drawn, "id").rowsBetween(Window.unboundedPreceding, 0)
    bounded = rows.withColumn("chars", F.sum(F.length("d.text")).over(by_hash)).where(F.col("chars") <= SAMPLE_CHARS // 2)
    found = bounded.select("id", "label", "d").orderBy("id").collect()
    if {r["label"] for r in found} != {0, 1}:
        return None
    model = train([r["d"]["text"] for r in found], [r["label"] for r in found], [r["d"]["lang"] for r in found])
    model.taught = tuple(r["id"] for r in found)
    return model


def rated(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``logit`` and ``told`` (the language read from the text) of every whole text."""
    text = whole_texts(df[text_col])
    df = without(df, "logit", "told")
    if model is None:
        return df.withColumns({"logit": F.lit(NEVER), "told": F.lit("")})
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<logit:double,told:string>")
    def rates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            columns = zip(*[known.rate(text.as_py()) for text in batch], strict=True) if len(batch) else [[], []]
            kinds = (pa.float64(), pa.string())
            yield pa.StructArray.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], ["logit", "told"]
            )

    added = fresh_name(df.columns, "_rated")
    found = df.withColumn(added, rates.asNondeterministic()(text))
    return found.select(*df.columns, F.col(f"{added}.logit").alias("logit"), F.col(f"{added}.told").alias("told"))


def _cut(counts: np.ndarray) -> float:
    """The logit of a histogram (label, cell) where the shares of both labels on the wrong side add up
    to least; the middle of its range."""
    totals = np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(counts, axis=1)), axis=1) / totals
    errors = below[1] + below[0][-1] - below[0]
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    run = best[: 1 + int(np.argmax(np.append(np.diff(best) > 1, True)))]
    # Beyond the rows that were seen, no further than a step.
    some = np.flatnonzero(counts.sum(axis=0))
    low, high = max(run[0], some[0] - 1), min(run[-1], some[-1] + 2)
    return float(-END + CELL * (low + high) / 2)


def thresholds(
    rated_docs: DataFrame,
    labels: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    label_col: str = "toxic",
    where: Column | None = None,
) -> dict[str, float]:
    """The cut of each language that has one, and of any other ("").

    Documents are counted by language, label and cell of logit, so only counts come together.
    """
    known = known_labels(labels, id_col, label_col, where)
    if model is None:
        return {"": 0.0}
    kind = known.schema["id"].dataType.simpleString()
    taught = rated_docs.sparkSession.createDataFrame([(i,) for i in model.taught], f"id {kind}")
    cells = round(2 * END / CELL)
    cell = F.least(F.greatest(F.floor((F.col("logit") + END) / CELL), F.lit(0)), F.lit(cells - 1)).cast("int").alias("cell")
    rows = rated_docs.select(F.col(id_col).alias("id"), "told", cell).join(known, "id")
    rows = rows.join(F.broadcast(taught), "id", "left_anti")
    found: dict[str, np.ndarray] = {}
    for r in rows.groupBy("told", "label", "cell").count().collect():
        found.setdefault(r["told"], np.zeros((2, cells)))[r["label"], r["cell"]] += r["count"]
    if not found:
        return {"": 0.0}
    whole = sum(found.values())
    return {"": _cut(whole)} | {
        told: _cut(own + whole * (PRIOR / whole.sum())) for told, own in found.items() if told
    }


def scored(rated_docs: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """``rated_docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    df = without(rated_docs, "score", "predicted")
    named = [F.lit(v) for pair in cuts.items() for v in pair]
    cut = F.coalesce(F.try_element_at(F.create_map(*named), F.col("told")), F.lit(cuts[""]))
    z = F.least(F.greatest(F.col("logit") - cut, F.lit(NEVER)), F.lit(-NEVER))
    found = df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
