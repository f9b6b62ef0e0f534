"""Search over losses and strengths, all folds and settings fitted together.

The features are those of ``columns.feature_stages`` (categories filled by mode and one-hot, numbers
filled by mean and standardised), learned anew for every fold left out. They are not computed
anew: rows are packed once as raw columns, and what a fold's features are is a small matrix that
maps raw columns to them, made from totals less the fold's own numbers and counts. So one
pass per Newton step serves every fold, loss and strength.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.operators.newton import LOG, MODIFIED_HUBER, NO_FOLD, Fit, fit_many, pack, probability
from smudgelab.operators.packed_auc import pack_scores
from smudgelab.operators.sampling import assign_folds
from smudgelab.operators.scores import roc_auc
from smudgelab.operators.suite_encoder import category_counts, own_moments

# Losses and regularisation strengths of the search.
LOSSES = (LOG, MODIFIED_HUBER)
ALPHAS = (0.00001, 0.00003, 0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03)
#: Columns of the features up to which curvature matrices are summed.
MOST_COLUMNS = 2_000
#: Columns of a category up to which each is an expression of its own, which Spark compiles.
SPELLED_OUT = 32


def _place(text: Column, values: Sequence[str]) -> Column:
    """Place of a value from 1, past the last for null, 0 for any other."""
    return F.when(text.isNull(), F.lit(len(values) + 1)).otherwise(
        F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), text).cast("int")
    )


def _one_hot(text: Column, values: Sequence[str]) -> Column:
    """One 0/1 component per value, and one for null."""
    place = _place(text, values)
    if len(values) < SPELLED_OUT:
        return F.array(*[(place == i).cast("double") for i in range(1, len(values) + 2)])
    return F.transform(F.sequence(F.lit(1), F.lit(len(values) + 1)), lambda i: (i == place).cast("double"))


@dataclass(frozen=True)
class RawColumns:
    """How a row becomes raw columns: per number its scaled value and whether it is there, per
    category one column a value and one for null. Fixed by the whole train side."""

    dataset: S.DatasetSpec
    centre: dict[str, float]
    scale: dict[str, float]
    values: dict[str, list[str]]

    @property
    def width(self) -> int:
        """Raw columns with the constant one."""
        return 2 * len(self.dataset.numeric) + sum(len(v) + 1 for v in self.values.values()) + 1

    def vector(self) -> Column:
        """The raw columns of a row, less the constant one."""
        parts = [F.array(*self._number(c)) for c in self.dataset.numeric]
        for c, values in self.values.items():
            parts.append(_one_hot(F.col(c).cast("string"), values))
        return F.concat(*parts) if parts else F.array().cast("array<double>")

    def _number(self, c: str) -> tuple[Column, Column]:
        value = (F.col(c).cast("double") - F.lit(self.centre[c])) / F.lit(self.scale[c])
        return F.coalesce(value, F.lit(0.0)), F.col(c).isNotNull().cast("double")

    def weighed(self, weights: Sequence[float]) -> Column:
        """Sum of the raw columns times their weights, the constant one's last.

        Of a category's columns only the one that is set is looked up.
        """
        total, row = F.lit(float(weights[-1])), 0
        for c in self.dataset.numeric:
            for part in self._number(c):
                total, row = total + part * F.lit(float(weights[row])), row + 1
        for c, values in self.values.items():
            own = [0.0, *(float(w) for w in weights[row : row + len(values) + 1])]
            place = _place(F.col(c).cast("string"), values)
            total = total + F.element_at(F.array(*[F.lit(w) for w in own]), place + 1)
            row += len(values) + 1
        return total


@dataclass(frozen=True)
class TrainFacts:
    """Numbers and counts of each fold's own rows, collected: a row per fold, or fold and value."""

    folds: list[int]
    rows: np.ndarray  # (folds,)
    moments: dict[str, np.ndarray]  # column -> (folds, 5): n, mean, squared deviations, least, largest
    counts: dict[str, dict[str, np.ndarray]]  # column -> value -> (folds,)

    @classmethod
    def learn(cls, folded: DataFrame, dataset: S.DatasetSpec) -> TrainFacts | None:
        """None where the features would have too many columns."""
        found = own_moments(folded, dataset.numeric).orderBy("fold").collect()
        folds = [r["fold"] for r in found]
        moments = {
            c: np.array([[r[p + c] or 0.0 for p in ("n__", "mean__", "squares__", "low__", "high__")] for r in found])
            for c in dataset.numeric
        }
        counts: dict[str, dict[str, np.ndarray]] = {c: {} for c in dataset.categorical}
        if dataset.categorical:
            counted = category_counts(folded, dataset, ["fold"])
            most = MOST_COLUMNS * max(1, len(folds))
            cells = counted.limit(most + 1).collect()
            if len(cells) > most:
                return None
            for r in cells:
                counts[r["column"]].setdefault(r["value"], np.zeros(len(folds)))[folds.index(r["fold"])] += r["n"]
        facts = cls(folds, np.array([r["rows"] for r in found], dtype=float), moments, counts)
        return facts if facts.raw(dataset).width <= MOST_COLUMNS else None

    def _rest(self, column: str, without: int) -> tuple[float, float]:
        """Mean and deviation of the train side; filled cells count with the mean."""
        kept = [i for i, f in enumerate(self.folds) if f != without and self.moments[column][i, 0] > 0]
        if not kept:
            return 0.0, 0.0
        n, mean, squares, low, high = self.moments[column][kept].T
        centre = float((n * mean).sum() / n.sum())
        if low.min() == high.max():
            return centre, 0.0
        rows = sum(self.rows[i] for i, f in enumerate(self.folds) if f != without)
        return centre, float(np.sqrt((squares + n * (mean - centre) ** 2).sum() / rows))

    def raw(self, dataset: S.DatasetSpec) -> RawColumns:
        found = {c: self._rest(c, NO_FOLD) for c in dataset.numeric}
        return RawColumns(
            dataset,
            {c: m for c, (m, _) in found.items()},
            {c: s or 1.0 for c, (_, s) in found.items()},
            {c: sorted(values) for c, values in self.counts.items()},
        )

    def change(self, raw: RawColumns, without: int) -> np.ndarray:
        """Raw columns to features of the train side that leaves out a fold; the constant one is last."""
        numeric = raw.dataset.numeric
        own = len(numeric) + sum(len(v) for v in raw.values.values()) + 1
        change = np.zeros((raw.width, own))
        for j, c in enumerate(numeric):
            mean, spread = self._rest(c, without)
            if spread > 0:
                change[2 * j, j] = raw.scale[c] / spread
                change[2 * j + 1, j] = (raw.centre[c] - mean) / spread
        row, at = 2 * len(numeric), len(numeric)
        kept = [i for i, f in enumerate(self.folds) if f != without]
        for c, values in raw.values.items():
            left = [self.counts[c][v][kept].sum() for v in values]
            for k, n in enumerate(left):
                change[row + k, at + k] = float(n > 0)  # values not met in training count nothing
            if any(left):
                change[row + len(values), at + int(np.argmax(left))] = 1.0  # the first of the commonest
            row, at = row + len(values) + 1, at + len(values)
        change[-1, -1] = 1.0
        return change

    def rows_without(self, fold: int) -> float:
        return float(sum(n for n, f in zip(self.rows, self.folds, strict=True) if f != fold))


@dataclass(frozen=True)
class LinearModel:
    """A fitted binary model as one expression over the features."""

    raw: RawColumns
    coefficients: np.ndarray  # of the raw columns, the intercept last
    loss: str
    alpha: float

    def margin(self) -> Column:
        return self.raw.weighed(self.coefficients)

    def probability(self) -> Column:
        """Of the hit, as the loss defines it."""
        z = self.margin()
        if self.loss == MODIFIED_HUBER:
            return (F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0)) + 1) / 2
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _judged(shared: Broadcast):
    """Probabilities of a fold's rows under all settings fitted without it, packed by block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, losses = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("rows", "x", "y", "fold")}
                x, y = np.frombuffer(row["x"]).reshape(row["rows"], -1), np.frombuffer(row["y"], np.int32)
                fold = np.frombuffer(row["fold"], np.int32)
                for f in np.unique(fold):
                    at = fold == f
                    z = x[at] @ weights[int(f)].T
                    p = np.column_stack([probability(loss, z[:, k]) for k, loss in enumerate(losses)])
                    settings = len(losses)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(settings, f, dtype=np.int32)),
                            pa.array(np.arange(settings, dtype=np.int32)),
                            pa.array([y[at].tobytes()] * settings, pa.binary()),
                            pa.array([np.ascontiguousarray(p[:, k]).tobytes() for k in range(settings)], pa.binary()),
                        ],
                        ["fold", "setting", "hit", "p"],
                    )

    return run


def search(
    train: DataFrame,
    dataset: S.DatasetSpec,
    label: str,
    seed: int,
    losses: Sequence[str] = LOSSES,
    alphas: Sequence[float] = ALPHAS,
    folds: int = 5,
) -> tuple[LinearModel, dict[tuple[str, float], float]] | None:
    """The model of the best mean ROC AUC over the folds, and the mean of every setting.

    ``label`` is 0 or 1. A strength weighs half the squared coefficients (not the intercept) against the
    mean loss. Folds come from the row digest. None where the features have too many columns.
    """
    folded = assign_folds(train.where(F.col(label).isNotNull()), dataset.key, seed, folds)
    facts = TrainFacts.learn(folded, dataset)
    if facts is None:
        return None
    raw = facts.raw(dataset)
    rows = folded.select(F.lit(0).alias("gid"), raw.vector().alias("v"), F.col(label).cast("int").alias("code"), "fold")
    packed = pack(rows).persist(StorageLevel.MEMORY_AND_DISK)  # for the fits and the judging of the folds
    try:
        return _best(packed, facts, raw, losses, alphas)
    finally:
        packed.unpersist()


def _best(
    packed: DataFrame, facts: TrainFacts, raw: RawColumns, losses: Sequence[str], alphas: Sequence[float]
) -> tuple[LinearModel, dict[tuple[str, float], float]]:
    """The search over packed rows."""
    changes = {f: facts.change(raw, f) for f in facts.folds}
    settings = [(loss, alpha) for loss in losses for alpha in alphas]
    fits = [
        Fit(0, 1, loss, alpha * facts.rows_without(f), False, f) for f in facts.folds for loss, alpha in settings
    ]
    found = iter(fit_many(packed, fits, {0: raw.width}, changes))
    weights = {f: np.array([changes[f] @ next(found) for _ in settings]) for f in facts.folds}
    shared = packed.sparkSession.sparkContext.broadcast((weights, [loss for loss, _ in settings]))
    judged = packed.mapInArrow(_judged(shared), "fold int, setting int, hit binary, p binary")
    scores: dict[int, list[float]] = {}
    for r in roc_auc(judged, ["fold", "setting"], "hit", "p").collect():
        scores.setdefault(r["setting"], []).append(r["roc_auc"])
    means = {settings[i]: sum(values) / len(values) for i, values in scores.items()}
    # The first of the best, in the order of losses and strengths.
    loss, alpha = max(settings, key=lambda s: (means.get(s, -1.0), -settings.index(s)))
    whole = facts.change(raw, NO_FOLD)
    last = Fit(0, 1, loss, alpha * facts.rows_without(NO_FOLD), False, NO_FOLD)
    own = fit_many(packed, [last], {0: raw.width}, {NO_FOLD: whole})[0]
    return LinearModel(raw, whole @ own, loss, alpha), means


def search_report(
    spark: SparkSession,
    data: DataFrame,
    dataset: S.DatasetSpec,
    seed: int,
    losses: Sequence[str] = LOSSES,
    alphas: Sequence[float] = ALPHAS,
    folds: int = 5,
) -> DataFrame | None:
    """(loss, alpha, cv_roc_auc, roc_auc) of the best setting, judged on the test rows."""
    found = search(data.where("split = 'train'"), dataset, dataset.target, seed, losses, alphas, folds)
    if found is None:
        return None
    model, means = found
    judged = data.where("split = 'test'").select(
        F.col(dataset.target).cast("int").alias("hit"), model.probability().alias("p")
    )
    scored = pack_scores(judged, "hit", "p").select(
        F.lit(model.loss).alias("loss"),
        F.lit(model.alpha).alias("alpha"),
        F.lit(means[model.loss, model.alpha]).alias("cv_roc_auc"),
        "hit",
        "p",
    )
    return roc_auc(scored, ["loss", "alpha", "cv_roc_auc"], "hit", "p")
