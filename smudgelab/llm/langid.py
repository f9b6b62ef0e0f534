"""Language identification by averaged hashed subword embeddings and a linear softmax.

The subwords of a text are the character n-grams of its words (letters only, in lower
case, with a mark at both ends), hashed into a table of embeddings. A text is the average
of its subwords' embeddings; a linear layer and a softmax give its languages. Both are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled
rows, of as many languages as there are.

A softmax is sure of itself in languages it never saw, so rejection asks something else: how usual
the text's subwords are in the sample, as their mean log frequency. What is too unusual is
calibrated on rows that the training did not see, for texts of each length (``SCALES`` subwords), and the model
tells how many texts of each language it would reject had it not learned that language.

Prediction is one pass without a shuffle. As the layers are linear, each subword's
share of the logits is precomputed where that is narrower than its embedding.

Defined results: null texts and texts without a letter get ``und``, score 0, rejected;
an empty training table gives a model that answers ``und`` always. Columns that clash with
the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import bounded_batches, fresh_name, without

UNDETERMINED = "und"
#: Labelled rows that training looks at, per language and in all (``LEAST_ROWS`` per language at
#: least), and characters of their texts.
ROWS_PER_LANGUAGE, ROWS_IN_ALL, LEAST_ROWS = 800, 40_000, 20
SAMPLE_CHARS = 48_000_000
#: Size of the embedding table, n-gram sizes, passes over the sample and step size.
BUCKETS = 1 << 16
WIDTH = 16
SIZES = (2, 3)
EPOCHS, RATE = 4, np.float32(0.05)
#: Share of unseen texts in learned languages that calibration rejects, and how much further than that, as
#: a share of the way from the middle, the limits lie.
REJECTED_SHARE, MARGIN = 0.001, 0.5
#: Subwords of the pieces that rejection is calibrated on; shorter texts are never rejected for it.
SCALES = (8, 16, 32, 64, 128, 256, 512)
#: Languages that the model reports on as if it had not learned them.
REPORTED = 20
#: Languages whose sampling rates may be broadcast.
MOST_BROADCAST = 100_000
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_MULTIPLIER = np.uint32(0x9E3779B1)


def subwords(text: str) -> np.ndarray:
    """Table rows of the subwords of a whole text; empty if it has no letter."""
    if not _LETTER.search(text):
        return np.empty(0, dtype=np.int32)
    letters = _NOT_LETTERS.sub(" ", text).lower().strip()
    points = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype=np.uint32)
    space = points == 32
    found = []
    hashed = np.zeros(len(points), dtype=np.uint32)
    inside = np.ones(len(points), dtype=bool)
    for n in range(1, max(SIZES) + 1):
        # hashed[i] covers points[i : i + n]; a space may stand only at its ends.
        hashed = hashed[: len(points) - n + 1]
        inside = inside[: len(points) - n + 1]
        if n > 2:
            inside = inside & ~space[n - 2 : len(points) - 1][: len(inside)]
        hashed = (hashed ^ points[n - 1 :]) * _MULTIPLIER
        hashed ^= hashed >> np.uint32(15)
        if n in SIZES:
            keep = inside & ~space[: len(inside)] if n == 1 else inside
            found.append((hashed[keep] ^ np.uint32(n)) % np.uint32(BUCKETS))
    return np.concatenate(found).astype(np.int32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # a subword's share of the logits, or its embedding
    head: np.ndarray | None  # of embeddings
    bias: np.ndarray
    usual: np.ndarray  # log frequency of each subword in the sample
    limits: np.ndarray  # least mean of it for texts of ``SCALES`` subwords
    #: Shares of texts rejected: of learned languages, and of each language as if not learned.
    calibration: dict[str, float] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether the text is rejected."""
        rows = subwords(text or "")
        if not len(rows) or not self.languages:
            return UNDETERMINED, 0.0, True
        total, usual = np.zeros(self.table.shape[1]), 0.0
        for part in range(0, len(rows), 1 << 18):
            at = rows[part : part + (1 << 18)]
            total += self.table[at].sum(axis=0, dtype=np.float64)
            usual += float(self.usual[at].sum(dtype=np.float64))
        z = total / len(rows)
        z = (z if self.head is None else z @ self.head) + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), usual / len(rows) < self.least(len(rows))

    def least(self, n: int) -> float:
        """The limit for a text of ``n`` subwords."""
        return float(np.interp(np.log2(n), np.log2(SCALES), self.limits)) if n >= SCALES[0] else -np.inf


def _empty() -> Model:
    none = np.zeros((BUCKETS, 0), dtype=np.float32)
    return Model((), none, None, np.zeros(0), np.zeros(BUCKETS, dtype=np.float32), np.zeros(len(SCALES)))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model:
    """Fits on the texts but every fifth, which calibrate the limits."""
    names = tuple(sorted(set(languages)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    head = np.zeros((WIDTH, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    bags = [np.unique(subwords(t), return_counts=True) for t in texts]
    goal = [names.index(x) for x in languages]
    usable = [i for i, (rows, _) in enumerate(bags) if len(rows)]
    fitted = [i for k, i in enumerate(usable) if k % 5 or len(usable) < 50]
    checked = [i for k, i in enumerate(usable) if not k % 5 and len(usable) >= 50]
    # Adaptive rates: a step is divided by the root of the squared gradients so far, per
    # weight of the head and per row of the table (rare subwords keep large steps).
    seen_head, seen_bias = np.full_like(head, 1e-6), np.full_like(bias, 1e-6)
    seen_rows = np.full(BUCKETS, 1e-8, dtype=np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(fitted):
            rows, counts = bags[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ table[rows]
            error = _softmax(mean @ head + bias)
            error[goal[i]] -= 1
            back = head @ error
            down = np.outer(mean, error)
            seen_head += down**2
            head -= RATE * down / np.sqrt(seen_head)
            seen_bias += error**2
            bias -= RATE * error / np.sqrt(seen_bias)
            seen_rows[rows] += share**2 * np.float32((back**2).mean())
            table[rows] -= (RATE * share / np.sqrt(seen_rows[rows]))[:, None] * back
    wide = len(names) > WIDTH
    logits = table if wide else (table @ head).astype(np.float32)
    shares = _shares([bags[i] for i in fitted], [goal[i] for i in fitted], len(names))
    usual = _usual(shares, range(len(names)))
    # Whole rows, so that pieces of any length can be drawn from them.
    held = [(goal[i], subwords(texts[i])) for i in checked]
    limits, lost = _limits([x for _, x in held], usual, rng)
    report = {"learned": lost}
    for k, name in enumerate(names[:REPORTED]) if len(names) > 1 else []:
        without_it = _usual(shares, [j for j in range(len(names)) if j != k])
        mine = [x for g, x in held if g == k]
        unknown = Model(names, logits, head, bias, without_it, limits)
        if mine:
            report[name] = float(np.mean([without_it[x].mean() < unknown.least(len(x)) for x in mine]))
    return Model(names, logits, head if wide else None, bias, usual, limits, report)


def _shares(bags: list[tuple[np.ndarray, np.ndarray]], goals: list[int], n: int) -> list[np.ndarray]:
    """How frequent each subword is in each language."""
    counts = [np.zeros(BUCKETS) for _ in range(n)]
    for (rows, seen), goal in zip(bags, goals, strict=True):
        counts[goal][rows] += seen
    return [(c / max(1.0, c.sum())).astype(np.float32) for c in counts]


def _usual(shares: list[np.ndarray], languages: Iterable[int]) -> np.ndarray:
    """Log frequency of each subword, all languages alike; a subword never seen counts a little."""
    chosen = [shares[k] for k in languages]
    mean = sum(chosen, np.zeros(BUCKETS)) / max(1, len(chosen))
    return np.log(mean + 5e-8).astype(np.float32)


def _limits(held: list[np.ndarray], usual: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """The limits by length, and the share of held-out rows that they reject."""
    limits = np.full(len(SCALES), -np.inf)
    for k, n in enumerate(SCALES):
        means = [float(usual[rng.choice(x, n, replace=False)].mean()) for x in held if len(x) >= n]
        if means:
            low, middle = np.quantile(means, [REJECTED_SHARE, 0.5])
            limits[k] = low - MARGIN * (middle - low)
    # Without longer rows to look at, the limit of a shorter length holds.
    for k in range(1, len(SCALES)):
        if limits[k] == -np.inf:
            limits[k] = limits[k - 1]
    limits = np.where(np.isfinite(limits), limits, -1e9)
    judge = Model(("",), usual[:, None], None, np.zeros(1), usual, limits)
    lost = [usual[x].mean() < judge.least(len(x)) for x in held]
    return limits, float(np.mean(lost)) if lost else 0.0


def fit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    where: Column | None = None,
) -> Model:
    """Trains on at most ``rows_per_language`` rows of every language, fewer where languages are many.

    A language's rows are those with the smallest hashes of id and text, so reruns agree. Texts
    longer than a language's part of ``SAMPLE_CHARS`` don't teach.
    """
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if where is not None:
        labelled = labelled.where(where)
    languages = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("rows"))
    n = languages.count()
    if not n:
        return _empty()
    most = min(rows_per_language, max(LEAST_ROWS, ROWS_IN_ALL // n))
    room = SAMPLE_CHARS // n
    # The rate leaves 1.3 times the wanted rows of each language, give or take chance. One row per language.
    rates = languages.select("lang", F.least(F.lit(1.0), F.lit(1.3 * most) / F.col("rows")).alias("rate"))
    rows = labelled.select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col), F.lit("language sample")).alias("drawn"),
        F.length(text_col).alias("chars"),
    )
    rows = rows.join(F.broadcast(rates) if n <= MOST_BROADCAST else rates, "lang")
    cells = 1 << 30
    thinned = rows.where((F.pmod("drawn", F.lit(cells)) < F.col("rate") * float(cells)) & (F.col("chars") <= room))
    first = Window.partitionBy("lang").orderBy("drawn", "text")
    earlier = F.sum("chars").over(first.rowsBetween(Window.unboundedPreceding, -1))
    kept = thinned.withColumn("place", F.row_number().over(first)).withColumn("before", F.coalesce(earlier, F.lit(0)))
    sample = kept.where((F.col("place") <= most) & (F.col("before") + F.col("chars") <= room))
    found = sample.select("lang", "text", "drawn").orderBy("drawn", "text").collect()
    return train([r["text"] for r in found], [r["lang"] for r in found])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected`` for every whole text."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            columns = zip(*[known.predict(text.as_py()) for text in batch], strict=True) if len(batch) else [[], [], []]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], ["lang", "score", "rejected"]
            )

    text = df[text_col].cast("string")
    df = without(df, "lang_pred", "score", "rejected")
    added = fresh_name(df.columns, "_found")
    # Not to be computed again by a filter on the result.
    found = df.withColumn(added, predicted.asNondeterministic()(text))
    return found.select(
        *df.columns,
        F.col(f"{added}.lang").alias("lang_pred"),
        F.col(f"{added}.score").alias("score"),
        F.col(f"{added}.rejected").alias("rejected"),
    )
