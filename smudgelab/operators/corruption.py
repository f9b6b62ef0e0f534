"""Error injection as column expressions over whole tables.

A damaged row is recognised by its digest alone (see ``DigestCuts``), so one
select writes the damaged cells and leaves all others untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smudgelab import spec as S
from smudgelab.functions import sizes
from smudgelab.functions.hashing import digest, text_digest
from smudgelab.operators.lookup import lookup_join
from smudgelab.operators.ranking import DigestCuts, digest_rank
from smudgelab.operators.sampling import Prepared, choose_columns, row_digest

CLEAN_PREFIX = "clean_"
LITERAL_DOMAIN = 200


@dataclass(frozen=True)
class Damage:
    """What a corruption needs to know besides the frame."""

    dataset: S.DatasetSpec
    spec: S.CorruptionSpec
    side: str
    columns: tuple[str, ...]


# fn(frame with boolean `chosen`, damage) -> the same frame with damaged columns
CorruptFn = Callable[[DataFrame, Damage], DataFrame]


@dataclass(frozen=True)
class CorruptionType:
    """A registered way of damaging cells.

    ``always_changes`` is false when a chosen row may come out as it was; the
    manifest then holds only the rows that really differ.
    """

    eligible: Callable[[S.DatasetSpec], Sequence[str]]
    apply: CorruptFn
    always_changes: bool = True


REGISTRY: dict[str, CorruptionType] = {}


def register_corruption(name: str, kind: CorruptionType) -> None:
    """Extension point for new error types."""
    REGISTRY[name] = kind


def _set_missing(df: DataFrame, damage: Damage) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            c: F.when(F.col("chosen"), F.lit(None).cast(types[c])).otherwise(F.col(c))
            for c in damage.columns
        }
    )


def scale_factor(damage: Damage, column: str) -> int:
    factors = damage.spec.factors
    return factors[int(text_digest(damage.spec.seed, f"factor:{damage.side}", column)[:8], 16) % len(factors)]


def _wider(kind: T.DataType, most: int = 1) -> T.DataType:
    """Whole numbers are kept as bigint, decimals get the digits of the largest factor."""
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(min(38, kind.precision + len(str(most))), kind.scale)
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def _scale(df: DataFrame, damage: Damage) -> DataFrame:
    most = max(damage.spec.factors)
    types = {f.name: _wider(f.dataType, most) for f in df.schema.fields}
    return df.withColumns(
        {
            c: F.when(F.col("chosen"), (F.col(c).cast(types[c]) * scale_factor(damage, c)).cast(types[c]))
            .otherwise(F.col(c).cast(types[c]))
            for c in damage.columns
        }
    )


def _shift_domain(df: DataFrame, damage: Damage, column: str) -> DataFrame:
    """old → new for the values met in chosen rows: one random order onto another."""
    values = df.where(F.col("chosen") & F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    purpose = f"{damage.side}:{column}"
    ranked = [
        digest_rank(
            values.withColumn("d", digest(damage.spec.seed, f"{end}:{purpose}", "v")), "d"
        ).select("pos", F.col("v").alias(end))
        for end in ("old", "new")
    ]
    return ranked[0].join(ranked[1], "pos").select("old", "new")


def _shift_categories(df: DataFrame, damage: Damage) -> DataFrame:
    for column in damage.columns:
        # Spark makes both digests, so that a value has the same one on either path.
        purpose = f"{damage.side}:{column}"
        values = (
            df.where(F.col("chosen") & F.col(column).isNotNull())
            .select(F.col(column).alias("v"))
            .distinct()
            .limit(LITERAL_DOMAIN + 1)
            .select("v", *[digest(damage.spec.seed, f"{end}:{purpose}", "v").alias(end) for end in ("old", "new")])
            .collect()
        )
        if not values:
            continue
        kind = df.schema[column].dataType
        if len(values) <= LITERAL_DOMAIN:
            old, new = (
                [row["v"] for row in sorted(values, key=lambda row: row[end])] for end in ("old", "new")
            )
            pairs = [F.lit(v).cast(kind) for pair in zip(old, new, strict=True) for v in pair]
            shifted = F.try_element_at(F.create_map(*pairs), F.col(column))
            df = df.withColumn(column, F.when(F.col("chosen"), shifted).otherwise(F.col(column)))
        else:
            names = df.columns
            domain = _shift_domain(df, damage, column).withColumnRenamed("old", column)
            shifted = F.when(F.col("chosen"), F.col("new")).otherwise(F.col(column))
            df = lookup_join(df, domain, [column]).withColumn(column, shifted).select(*names)
    return df


register_corruption(S.MCAR, CorruptionType(lambda d: d.features, _set_missing))
register_corruption(S.SCAR, CorruptionType(lambda d: d.numeric, _scale))
register_corruption(S.CSCAR, CorruptionType(lambda d: d.categorical, _shift_categories, always_changes=False))


@dataclass(frozen=True)
class Corrupted:
    """Result of an error injection.

    ``flagged`` has the damaged table, ``is_corrupted`` and the clean value of
    each damaged column under ``clean_<column>``.
    """

    flagged: DataFrame
    key: str
    columns: tuple[str, ...]

    @property
    def data(self) -> DataFrame:
        return self.flagged.drop("is_corrupted", *[CLEAN_PREFIX + c for c in self.columns])

    @property
    def rows(self) -> DataFrame:
        return self.flagged.where("is_corrupted").select(self.key)


def corrupt(
    df: DataFrame,
    dataset: S.DatasetSpec,
    spec: S.CorruptionSpec,
    side: str = "all",
    where: Column | None = None,
    cuts: DigestCuts | None = None,
) -> Corrupted:
    """Damage a share of the rows (those meeting ``where``) in a share of the columns.

    Which rows are hit depends on the seed, side and share only, not on the error
    type, and the rows of a smaller share are among those of a larger one. ``cuts``
    may be handed in where the rows were counted before.
    """
    unchanged = Corrupted(df.withColumn("is_corrupted", F.lit(False)), dataset.key, ())
    if spec.is_identity:
        return unchanged
    if spec.kind not in REGISTRY:
        raise ValueError(f"unknown corruption type {spec.kind}; known: {sorted(REGISTRY)}")
    kind = REGISTRY[spec.kind]
    columns = choose_columns(
        list(kind.eligible(dataset)), spec.seed, spec.column_percent, f"column:{side}:{spec.kind}"
    )
    if not columns:
        return unchanged
    h = row_digest(spec.seed, side, dataset.key)
    cuts = cuts or DigestCuts(df if where is None else df.where(where), h)
    if cuts.total == 0:
        raise ValueError("data must not be empty")
    chosen = h <= cuts.cut(sizes.sample_size(spec.row_percent, cuts.total))
    if where is not None:
        chosen = chosen & where
    damage = Damage(dataset, spec, side, tuple(columns))
    marked = df.withColumns({"chosen": chosen, **{CLEAN_PREFIX + c: F.col(c) for c in columns}})
    damaged = kind.apply(marked, damage)
    hit = F.col("chosen")
    if not kind.always_changes:
        hit = hit & any_differs([(F.col(c), F.col(CLEAN_PREFIX + c)) for c in columns])
    return Corrupted(damaged.withColumn("is_corrupted", hit).drop("chosen"), dataset.key, tuple(columns))


def any_differs(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """True when a pair differs; two nulls are equal."""
    result: Column = F.lit(False)
    for a, b in pairs:
        result = result | ~a.eqNullSafe(b)
    return result


@dataclass(frozen=True)
class ModeResult:
    """A prepared table after damage on the sides its mode names."""

    data: DataFrame
    sides: dict[str, Corrupted]

    def corrupted_rows(self, key: str) -> DataFrame | None:
        """(side, row_id) of every damaged row."""
        frames = [
            c.rows.select(F.lit(side).alias("side"), F.col(key).cast("string").alias("row_id"))
            for side, c in self.sides.items()
        ]
        result = None
        for frame in frames:
            result = frame if result is None else result.unionByName(frame)
        return result

    def corrupted_columns(self) -> list[tuple[str, str]]:
        return [(side, c) for side, done in self.sides.items() for c in done.columns]


def corrupt_by_mode(prepared: Prepared, mode: str, spec: S.CorruptionSpec) -> ModeResult:
    """Damage the train side, the test side, both or none."""
    if mode not in S.DIRTY_SIDES:
        raise ValueError(f"unknown experiment mode {mode}")
    data = prepared.data
    sides: dict[str, Corrupted] = {}
    for side in S.DIRTY_SIDES[mode]:
        cuts = None if spec.is_identity else prepared.row_cuts(side, spec.seed)
        done = corrupt(data, prepared.dataset, spec, side, F.col("split") == side, cuts)
        sides[side] = done
        data = done.data
    return ModeResult(data, sides)


def is_meaningful(mode: str, corrupted_rows: int, corrupted_columns: int) -> bool:
    """Clean-clean must have no damage; every other mode must have some."""
    if mode == S.CLEAN_CLEAN:
        return corrupted_rows == 0 and corrupted_columns == 0
    return corrupted_rows > 0 and corrupted_columns > 0


def meaningful(mode: str = "tag", rows: str = "corrupted_rows", columns: str = "corrupted_columns") -> Column:
    """The same test on columns of an experiment table."""
    clean = F.col(mode) == S.CLEAN_CLEAN
    none, both = (F.col(rows) == 0) & (F.col(columns) == 0), (F.col(rows) > 0) & (F.col(columns) > 0)
    return F.when(clean, none).otherwise(both)


def audit(done: Corrupted, where: Column | None = None) -> DataFrame:
    """Rows, rows changed and the changed share per damaged column; one aggregation."""
    flagged = done.flagged if where is None else done.flagged.where(where)
    return _changes(flagged, done.columns)


def audit_mode(result: ModeResult) -> DataFrame | None:
    """The audit of every damaged side, over the rows of that side."""
    parts = [
        audit(done, F.col("split") == side).select(F.lit(side).alias("side"), "*")
        for side, done in result.sides.items()
        if done.columns
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def audit_tables(clean: DataFrame, dirty: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The same audit for two stored versions of a table, matched on the key."""
    before = clean.select(key, *[F.col(c).alias(CLEAN_PREFIX + c) for c in columns])
    return _changes(before.join(dirty.select(key, *columns), key), columns)


def _changes(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    counted = both.agg(
        F.count("*").alias("rows"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(CLEAN_PREFIX + c))).alias(c) for c in columns],
    )
    return counted.unpivot(["rows"], list(columns), "column", "changed").select(
        "column", "rows", "changed", (F.col("changed") / F.col("rows")).alias("rate")
    )
