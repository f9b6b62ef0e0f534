"""Exact-size, seeded samples, splits, folds and batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.functions import sizes
from smudgelab.functions.hashing import digest, leading_number, text_digest
from smudgelab.operators.ranking import DigestCuts, digest_rank


def exact_sample(df: DataFrame, key: str, seed: int, n: int, purpose: str = "row") -> DataFrame:
    """Exactly n rows without replacement."""
    h = digest(seed, purpose, key)
    return df.where(h <= DigestCuts(df, h).cut(n))


def percent_sample(df: DataFrame, key: str, seed: int, percent: float, purpose: str = "row") -> DataFrame:
    """A share of the rows, at least one."""
    h = digest(seed, purpose, key)
    cuts = DigestCuts(df, h)
    return df.where(h <= cuts.cut(sizes.sample_size(percent, cuts.total)))


def choose_names(names: Sequence[str], seed: int, n: int, purpose: str = "column") -> list[str]:
    """n names without replacement; the result keeps the given order."""
    chosen = set(sorted(names, key=lambda c: (text_digest(seed, purpose, c), c))[:n])
    return [c for c in names if c in chosen]


def choose_columns(names: Sequence[str], seed: int, percent: float, purpose: str = "column") -> list[str]:
    if not names:
        return []
    return choose_names(names, seed, sizes.sample_size(percent, len(names)), purpose)


def cap_features(dataset: S.DatasetSpec, seed: int, most: int | None = S.MAX_FEATURES) -> S.DatasetSpec:
    """At most ``most`` feature columns; None: all."""
    if most is None or len(dataset.features) <= most:
        return dataset
    return dataset.keep(choose_names(dataset.features, seed, most, "feature"))


def cap_classes(df: DataFrame, target: str, seed: int, most: int = S.MAX_CLASSES) -> DataFrame:
    """Rows of at most ``most`` target values, all rows of each kept value.

    Rows without a target stay in either case.
    """
    classes = df.where(F.col(target).isNotNull()).select(target).distinct()
    if classes.limit(most + 1).count() <= most:
        return df
    kept = classes.orderBy(digest(seed, "class", target), target).limit(most).collect()
    return df.where(F.col(target).isNull() | F.col(target).isin([row[0] for row in kept]))


def keep_classes(df: DataFrame, target: str, classes: Sequence) -> DataFrame:
    return df.where(F.col(target).isin(list(classes)))


def split_train_test(
    df: DataFrame, key: str, seed: int, test_size: float = S.DEFAULT_TEST_SIZE
) -> DataFrame:
    """Adds ``split``; the test side has exactly the rounded-up share of the rows."""
    h = digest(seed, "split", key)
    cuts = DigestCuts(df, h)
    last = cuts.cut(sizes.test_rows(cuts.total, test_size))
    return df.withColumn("split", F.when(h <= last, "test").otherwise("train"))


def cap_train(df: DataFrame, key: str, seed: int, most: int | None = S.MAX_TRAIN_ROWS) -> DataFrame:
    """At most ``most`` rows on the train side (None: all); the test side is untouched."""
    if most is None:
        return df
    is_train = F.col("split") == "train"
    h = digest(seed, "train", key)
    cuts = DigestCuts(df.where(is_train), h)
    if cuts.total <= most:
        return df
    return df.where(~is_train | (h <= cuts.cut(most)))


@dataclass(frozen=True)
class Prepared:
    """A capped and split table; ``data`` has key, features, target and split."""

    data: DataFrame
    dataset: S.DatasetSpec
    _side_cuts: dict[tuple[str, int], DigestCuts] = field(default_factory=dict)

    def row_cuts(self, side: str, seed: int) -> DigestCuts:
        """Where to cut the rows of a side; counted once for all shares and types."""
        if (side, seed) not in self._side_cuts:
            rows = self.data.where(F.col("split") == side)
            self._side_cuts[side, seed] = DigestCuts(rows, row_digest(seed, side, self.dataset.key))
        return self._side_cuts[side, seed]


def row_digest(seed: int, side: str, key: str) -> Column:
    """Order in which rows of a side are picked for damage."""
    return digest(seed, f"row:{side}", key)


def prepare(
    df: DataFrame,
    dataset: S.DatasetSpec,
    seed: int,
    test_size: float = S.DEFAULT_TEST_SIZE,
    max_rows: int | None = S.MAX_TRAIN_ROWS,
    max_features: int | None = None,
    max_classes: int | None = None,
) -> Prepared:
    """Feature cap, class cap, split, then train cap (after the split).

    Features and classes are capped only where asked for, and the target of a regression
    never is. ``max_rows`` bounds the labelled rows of a fit.
    """
    if seed is None or test_size is None or not dataset.target:
        raise ValueError("seed, test size and target must be set")
    dataset = cap_features(dataset, seed, max_features)
    data = df.select(dataset.key, *dataset.features, dataset.target)
    if max_classes is not None and dataset.task != "regression":
        data = cap_classes(data, dataset.target, seed, max_classes)
    data = split_train_test(data, dataset.key, seed, test_size)
    return Prepared(cap_train(data, dataset.key, seed, max_rows), dataset)


def assign_folds(df: DataFrame, key: str, seed: int, folds: int = 10) -> DataFrame:
    """Adds ``fold`` in 0..folds-1, near-equal in size; no shuffle."""
    number = leading_number(digest(seed, "fold", key))
    return df.withColumn("fold", F.pmod(number, F.lit(folds)).cast("int"))


def assign_batches(
    df: DataFrame, key: str, seed: int, limit: int | Column, group: Sequence[str] = ()
) -> DataFrame:
    """Adds the position in digest order and ``batch`` = position over the limit."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    ranked = digest_rank(df.withColumn("batch_digest", digest(seed, "batch", key)), "batch_digest", group)
    return ranked.withColumn("batch", F.floor(F.col("pos") / limit).cast("bigint")).drop("batch_digest")
