"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its emission weighs features of the line and of the lines
before and after it (shares of capitals, digits, marks, repeated words, ...), transitions weigh what
neighbouring lines are. The forward-backward algorithm gives each line's marginal probability of
being good; their mean, weighted by the lines' lengths, rates the document.

The labels are of documents, so lines are taught in rounds: at first a line has its
document's label, then lines of bad documents that the model finds surely good are taught as good.
Teaching is in numpy, on a bounded sample (``ROWS_PER_LABEL`` documents of each label with at most
``MOST_LINES`` lines); tasks send the sample's features, never texts, to the driver. The threshold comes from all
labelled documents: a mergeable histogram of their ratings by label, cut where the two shares of errors add
up to least. Scores are shifted so that ``LEAST_SCORE`` is that cut.

Rating is one pass without a shuffle over whole texts.

Defined results: null and empty texts, and those without a word, have no good line and get the lowest rating.
Labels other than 0 and 1 teach nothing; of a repeated id the highest label counts, and the smallest text teaches.
Without labels of both kinds every rating is the lowest. Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab.llm.common import bounded_batches, fresh_name, sampled, whole_texts, without

#: Labelled rows that teach, per label, and lines of each at most (longer ones are only rated).
ROWS_PER_LABEL, MOST_LINES = 2000, 200
#: Rounds of teaching, steps in each, their size, and the penalty of large weights.
ROUNDS, STEPS, RATE, PENALTY = 3, 150, 0.08, 1e-3
#: Marginal from which a line of a bad document is taught as good.
SURE = 0.9
#: Ratings are log-odds within +-END, counted in cells of this width.
END, CELL = 12.0, 0.02
#: Scores from here on predict 1.
LEAST_SCORE = 0.7
FEATURES = (
    "chars", "capitals", "digits", "symbols", "shouts", "bars", "points", "distinct", "adjacent",
    "word_length", "seen", "words", "foreign", "variety",
)
SYMBOLS, POINTS = "#*$%&<>~^=+@_{}[]\\/", ".,;:?'\"()-"
_LETTER, _CAPITAL, _DIGIT, _SYMBOL, _SHOUT, _BAR, _POINT, _FOREIGN = range(1, 9)


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000."""
    table = np.zeros(0x3000, dtype=np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c.isalpha():
            table[code] = _CAPITAL if c.isupper() else _LETTER if code < 128 else _FOREIGN
        elif c.isdigit():
            table[code] = _DIGIT
    for chars, kind in ((SYMBOLS, _SYMBOL), ("!", _SHOUT), ("|", _BAR), (POINTS, _POINT)):
        table[[ord(c) for c in chars]] = kind
    return table


_CLASSES = _classes()


@dataclass
class Lines:
    """Lines of several documents, in order."""

    starts: np.ndarray  # first line of each document, and the number of lines
    chars: np.ndarray
    features: np.ndarray  # (lines, FEATURES)


def lines_of(texts: list[str]) -> Lines:
    """All lines with a word, of whole texts."""
    kept: list[str] = []
    counts: list[tuple] = []
    starts = [0]
    for text in texts:
        seen: set[str] = set()
        for line in text.split("\n"):
            words = line.split()
            if not words:
                continue
            kept.append(line)
            counts.append((len(line), len(words), len(set(words)), sum(map(eq, words, words[1:])), line in seen))
            seen.add(line)
        starts.append(len(kept))
    if not kept:
        return Lines(np.array(starts), np.zeros(0), np.zeros((0, len(FEATURES)), dtype=np.float32))
    chars, words, distinct, adjacent, seen_before = np.array(counts, dtype=np.float64).T
    codes = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _CLASSES[np.minimum(codes, len(_CLASSES) - 1)]
    begin = np.concatenate(([0], np.cumsum(chars[:-1]))).astype(np.int64)
    n = [np.add.reduceat(kinds == k, begin, dtype=np.int64) for k in range(9)]
    letters = np.maximum(1, n[_LETTER] + n[_CAPITAL] + n[_FOREIGN])
    columns = [
        np.log1p(chars),
        n[_CAPITAL] / letters,
        n[_DIGIT] / chars,
        np.minimum(n[_SYMBOL] / words, 4),
        np.minimum(n[_SHOUT] / words, 3),
        np.minimum(n[_BAR] / words, 2),
        np.minimum(n[_POINT] / words, 3),
        distinct / words,
        adjacent / words,
        np.minimum(chars / words, 40),
        seen_before,
        np.log1p(words),
        n[_FOREIGN] / letters,
        np.log1p(distinct) / np.log1p(words),
    ]
    return Lines(np.array(starts), chars, np.column_stack(columns).astype(np.float32))


def joined(parts: list[Lines]) -> Lines:
    sizes = [np.diff(p.starts) for p in parts]
    return Lines(
        np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *sizes])))),
        np.concatenate([np.zeros(0), *[p.chars for p in parts]]),
        np.concatenate([np.zeros((0, len(FEATURES)), dtype=np.float32), *[p.features for p in parts]]),
    )


class Chains:
    """Line positions of all documents by step, so that a step moves every document at once."""

    def __init__(self, starts: np.ndarray) -> None:
        sizes = np.diff(starts)
        by_size = np.argsort(-sizes, kind="stable")
        open_ = np.searchsorted(-sizes[by_size], -np.arange(1, sizes.max(initial=0) + 1), side="right")
        #: Lines at step t of the documents that have so many, the longest first.
        self.at = [starts[by_size[:n]] + t for t, n in enumerate(open_)]
        self.first = np.zeros(starts[-1], dtype=bool)
        self.last = np.zeros(starts[-1], dtype=bool)
        some = sizes > 0
        self.first[starts[:-1][some]] = True
        self.last[starts[1:][some] - 1] = True

    def inputs(self, features: np.ndarray) -> np.ndarray:
        """Features of each line, of the lines beside it, of the ends, and a constant."""
        before, after = np.zeros_like(features), np.zeros_like(features)
        before[1:], after[:-1] = features[:-1], features[1:]
        before[self.first], after[self.last] = 0, 0
        ends = np.column_stack((self.first, self.last, np.ones(len(features))))
        return np.concatenate((features, before, after, ends.astype(features.dtype)), axis=1)

    def marginals(self, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(line is good), expected moves (2, 2), log of the partition sum.

        ``emission``: log-odds of good by line; ``move``: log weights from state to state.
        """
        weight = np.exp(move - move.max())
        local = np.stack((np.zeros(len(emission)), emission), axis=1)
        local -= local.max(axis=1, keepdims=True)
        local = np.exp(local)
        forward, backward = np.empty_like(local), np.ones_like(local)
        norm = np.ones(len(emission))
        for t, at in enumerate(self.at):
            here = local[at] if t == 0 else local[at] * (forward[at - 1] @ weight)
            norm[at] = here.sum(axis=1)
            forward[at] = here / norm[at][:, None]
        for t in range(len(self.at) - 1, 0, -1):
            at = self.at[t]
            backward[at - 1] = (local[at] * backward[at]) @ weight.T / norm[at][:, None]
        good = forward * backward
        good = good[:, 1] / good.sum(axis=1)
        moves = np.zeros((2, 2))
        later = np.flatnonzero(~self.first)
        if len(later):
            pair = forward[later - 1][:, :, None] * weight * (local[later] * backward[later] / norm[later][:, None])[:, None, :]
            moves = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        total = np.log(norm).sum() + np.maximum(0, emission).sum() + len(later) * move.max()
        return good, moves, float(total)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def good(self, lines: Lines) -> np.ndarray:
        """Marginal probability of every line."""
        chains = Chains(lines.starts)
        return chains.marginals(self._emission(chains, lines), self.move)[0]

    def _emission(self, chains: Chains, lines: Lines) -> np.ndarray:
        scaled = (lines.features - self.centre) / self.spread
        return np.clip(chains.inputs(scaled) @ self.weights, -30, 30)

    def ratings(self, texts: list[str]) -> np.ndarray:
        """Log-odds of the length-weighted mean of the lines' marginals, within +-END."""
        lines = lines_of(texts)
        upto = [np.concatenate(([0.0], np.cumsum(x))) for x in (lines.chars * self.good(lines), lines.chars)]
        sums, all_ = (u[lines.starts[1:]] - u[lines.starts[:-1]] for u in upto)
        share = np.where(all_ > 0, sums / np.maximum(all_, 1), 0.0)
        least = 1 / (1 + np.exp(END))
        share = np.clip(share, least, 1 - least)
        return np.log(share / (1 - share))


def train(lines: Lines, labels: np.ndarray) -> Model:
    """``labels`` (0 or 1) of the documents; lines are taught in rounds."""
    spread = lines.features.std(axis=0)
    model = Model(lines.features.mean(axis=0), np.where(spread > 1e-6, spread, 1.0), np.zeros(3 * len(FEATURES) + 3))
    chains = Chains(lines.starts)
    inputs = chains.inputs((lines.features - model.centre) / model.spread).astype(np.float64)
    of_document = np.repeat(labels, np.diff(lines.starts)).astype(np.float64)
    # Both labels weigh the same, whatever their numbers.
    share = np.clip(of_document.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(of_document == 1, 0.5 / share, 0.5 / (1 - share))
    taught = of_document.copy()
    later = np.flatnonzero(~chains.first)
    for round_ in range(ROUNDS):
        if round_:
            good = model.good(lines)
            taught = np.where((of_document == 0) & (good > SURE), 1.0, of_document)
        seen = np.zeros((2, 2))
        np.add.at(seen, (taught[later - 1].astype(int), taught[later].astype(int)), 1)
        flat = np.concatenate((model.weights, model.move.ravel()))
        mean, square = np.zeros_like(flat), np.zeros_like(flat)
        for step in range(1, STEPS + 1):
            weights, move = flat[:-4], flat[-4:].reshape(2, 2)
            good, moves, _ = chains.marginals(np.clip(inputs @ weights, -30, 30), move)
            slope = inputs.T @ (weight * (good - taught)) / len(taught)
            shift = (moves - seen) / max(1, len(later))
            gradient = np.concatenate((slope, shift.ravel())) + PENALTY * flat
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            flat = flat - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        model.weights, model.move = flat[:-4], flat[-4:].reshape(2, 2)
    return model


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of documents that may teach, as bytes."""
    for batch in batches:
        rows = []
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lines = lines_of([text])
            if 0 < len(lines.chars) <= MOST_LINES:
                rows.append((label, lines.chars.astype("<f8").tobytes(), lines.features.astype("<f4").tobytes()))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        types = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], ["label", "chars", "features"]
        )


def known_labels(labels: DataFrame, id_col: str, label_col: str, where: Column | None) -> DataFrame:
    """(id, label): one row per labelled id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known if where is None else known.where(where)
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows_per_label: int = ROWS_PER_LABEL,
    where: Column | None = None,
) -> Model | None:
    """Teaches on at most ``rows_per_label`` documents of each label, those with the smallest
    hashes of their ids; ``where`` (over the labels) leaves rows out. None without both labels."""
    bounded_batches(docs.sparkSession)
    known = known_labels(labels, id_col, label_col, where)
    chosen = [sampled(known.where(F.col("label") == y), ["id"], rows_per_label, "quality sample") for y in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 x rows_per_label ids
    texts = docs.select(F.col(id_col).alias("id"), whole_texts(F.col(text_col)).alias("text"))
    rows = texts.join(sample, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = rows.select("id", "label", "text").orderBy("id").select("label", "text")
    table = found.mapInArrow(_taught, "label int, chars binary, features binary").toArrow()
    labels_of = table["label"].to_numpy()
    if set(labels_of.tolist()) != {0, 1}:
        return None
    parts = []
    for chars, features in zip(table["chars"].to_pylist(), table["features"].to_pylist(), strict=True):
        length = np.frombuffer(chars, dtype="<f8")
        shape = len(length), len(FEATURES)
        parts.append(Lines(np.array([0, len(length)]), length, np.frombuffer(features, dtype="<f4").reshape(shape)))
    return train(joined(parts), labels_of)


def rated(df: DataFrame, model: Model | None, text_col: str = "text", to: str = "rating") -> DataFrame:
    """``df`` with the rating (log-odds) of every whole text."""
    text = F.col(text_col)
    if model is None:
        return without(df, to).withColumn(to, F.lit(-END))
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def ratings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.ratings(batch.to_pylist()), type=pa.float64())

    added = fresh_name(df.columns, "_rating")
    found = df.withColumn(added, ratings(whole_texts(text)))
    return found.select(*[c for c in df.columns if c.lower() != to.lower()], F.col(added).alias(to))


def threshold(
    rated_docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    rating_col: str = "rating",
    where: Column | None = None,
) -> float:
    """The rating that parts the labels best, over all labelled documents.

    Documents are counted per label and cell of rating, so at most 2 x cells counts come
    together. The cut lies in the middle of the cells that do equally well.
    """
    known = known_labels(labels, id_col, label_col, where)
    cell = F.floor((F.col(rating_col) + END) / CELL).cast("int").alias("cell")
    counts = rated_docs.select(F.col(id_col).alias("id"), cell).join(known, "id").groupBy("label", "cell").count()
    cells = round(2 * END / CELL) + 1
    n = np.zeros((2, cells))
    for row in counts.collect():
        n[row["label"], min(max(row["cell"], 0), cells - 1)] += row["count"]
    totals = n.sum(axis=1)
    if not totals.all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(n, axis=1)), axis=1) / totals[:, None]
    errors = below[1] + 1 - below[0]  # good ones below the cut, bad ones from it on
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    run = best[: 1 + int(np.argmax(np.append(np.diff(best) > 1, True)))]
    return float(-END + CELL * (run[0] + run[-1]) / 2)


def scored(rated_docs: DataFrame, cut: float, rating_col: str = "rating") -> DataFrame:
    """``rated_docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``LEAST_SCORE`` on)."""
    shift = float(np.log(LEAST_SCORE / (1 - LEAST_SCORE)))
    up = F.col(rating_col) - F.lit(cut)
    df = without(rated_docs, "score", "predicted")
    scores = df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-up - F.lit(shift))))
    return scores.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
