"""Names, fixed values and the small descriptions passed between operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Error types.
MCAR = "MCAR"  # missing completely at random
SCAR = "SCAR"  # scaling completely at random
CSCAR = "CSCAR"  # categorical shift completely at random
NONE = "NONE"
CORRUPTING_TYPES = (MCAR, SCAR, CSCAR)

# Experiment modes, read as state of (train, test).
CLEAN_CLEAN = "CLEAN_CLEAN"
CLEAN_DIRTY = "CLEAN_DIRTY"
DIRTY_CLEAN = "DIRTY_CLEAN"
DIRTY_DIRTY = "DIRTY_DIRTY"
DIRTY_SIDES = {
    CLEAN_CLEAN: (),
    CLEAN_DIRTY: ("test",),
    DIRTY_CLEAN: ("train",),
    DIRTY_DIRTY: ("train", "test"),
}

# Model limits and default rates.
MAX_TRAIN_ROWS = 10_000
MAX_FEATURES = 500
MAX_CLASSES = 10
DEFAULT_TEST_SIZE = 0.3
DEFAULT_ROW_PERCENTS = (10, 20, 40)
DEFAULT_COLUMN_PERCENTS = (20,)
DEFAULT_SEEDS = (100, 200, 300)
DEFAULT_FACTORS = (10, 100, 1000)
NEIGHBOUR_COUNTS = (1, 3, 5, 10)
CLEAN_CLEAN_PERCENTS = (0, 10, 20, 40)

# Table of named datasets, their task and target column.
NAMED_DATASETS = (
    ("Airbnb", "classification", "Rating"),
    ("Company", "classification", "Sentiment"),
    ("Credit", "classification", "SeriousDlqin2yrs"),
    ("EEG", "classification", "Eye"),
    ("Marketing", "classification", "Income"),
    ("Movie", "classification", "genres"),
    ("Restaurant", "classification", "priceRange"),
    ("Sensor", "classification", "moteid"),
    ("Titanic", "classification", "Survived"),
    ("University", "classification", "expenses thous$"),
    ("USCensus", "classification", "Income"),
    ("KDD", "classification", "is_exciting_20"),
)


@dataclass(frozen=True)
class DatasetSpec:
    """Roles of the columns of a labelled table."""

    name: str
    key: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    task: str = "classification"

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @staticmethod
    def infer(
        df: DataFrame,
        name: str,
        key: str,
        target: str,
        drop: tuple[str, ...] = (),
        categorical_numbers: tuple[str, ...] = (),
        task: str = "classification",
    ) -> DatasetSpec:
        """Choose columns by type: strings and declared integers are categorical."""
        skip = {key, target, "split", *drop}
        fields = [f for f in df.schema.fields if f.name not in skip]
        numeric = tuple(
            f.name
            for f in fields
            if isinstance(f.dataType, T.NumericType) and f.name not in categorical_numbers
        )
        categorical = tuple(
            f.name
            for f in fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) or f.name in categorical_numbers
        )
        return DatasetSpec(name, key, target, numeric, categorical, task)

    def keep(self, columns: list[str]) -> DatasetSpec:
        """The same dataset with only the given feature columns."""
        chosen = set(columns)
        return replace(
            self,
            numeric=tuple(c for c in self.numeric if c in chosen),
            categorical=tuple(c for c in self.categorical if c in chosen),
        )


@dataclass(frozen=True)
class CorruptionSpec:
    """One way of damaging a table."""

    kind: str
    seed: int
    row_percent: float
    column_percent: float
    factors: tuple[int, ...] = DEFAULT_FACTORS

    def __post_init__(self) -> None:
        for label, value in (("row", self.row_percent), ("column", self.column_percent)):
            if not 0 <= value <= 100:
                raise ValueError(f"{label} percent must be between 0 and 100, got {value}")

    @property
    def is_identity(self) -> bool:
        return self.kind == NONE or self.row_percent == 0 or self.column_percent == 0
