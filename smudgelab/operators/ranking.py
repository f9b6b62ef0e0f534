"""Exact ranks and exact-n cuts without a global sort.

Digests are spread evenly, so their leading digits are balanced buckets. Counts
per bucket (map-side combined) say which bucket holds the n-th smallest digest;
only that bucket is looked at further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.functions.hashing import uniform
from smudgelab.operators.lookup import join_on, join_pinned

LEVEL_DIGITS = 4  # at most 65,536 counts per level reach the driver
PAST_LAST_DIGIT = "g"
SMALL_BUCKET = 5_000
CUT_GROUPS = 2_000
WINDOW_ROWS = 2_000_000  # rows one window task sorts
PIECES = 64
MOST_LEVELS = 4
MOST_PIECES = 1_024  # ranges that a domain is dealt into, and values sampled to cut it
CUT_SAMPLE = 10_000
ONE_GROUP = "every__row"
BUCKET = "rank__bucket"
SHARED_KEY = "cannot take exactly {} rows: rows at the cut share their key; give a key that is unique and not null"


class DigestCuts:
    """Finds the digest at or below which exactly n rows lie.

    The answer is one literal, so picking the sample is a row-wise filter with
    no shuffle and no join.
    """

    def __init__(self, df: DataFrame, digest_column: Column):
        self._rows = df.select(digest_column.alias("d"))
        self._levels: dict[str, list[tuple[str, int]]] = {}
        self.total = sum(count for _, count in self._level(""))

    def _level(self, prefix: str) -> list[tuple[str, int]]:
        if prefix not in self._levels:
            rows = self._rows.where(F.col("d").startswith(prefix)) if prefix else self._rows
            bucket = F.substring("d", 1, len(prefix) + LEVEL_DIGITS).alias("p")
            counts = rows.groupBy(bucket).agg(F.count("*").alias("n")).toPandas().sort_values("p")
            self._levels[prefix] = list(counts.itertuples(index=False, name=None))
        return self._levels[prefix]

    def cut(self, n: int) -> str:
        """Digest of the n-th smallest row, or a bound just above it; '' when n is 0.

        Fails if rows share the digest at the cut (their keys are equal or null): no
        filter on digests takes exactly n of them.
        """
        if n <= 0:
            return ""
        if n > self.total:
            raise ValueError(f"cannot take {n} of {self.total} rows")
        prefix, wanted = "", n
        while True:
            bucket, count = self._locate(prefix, wanted)
            wanted -= sum(c for b, c in self._level(prefix) if b < bucket)
            if wanted == count:
                return bucket + PAST_LAST_DIGIT
            if count <= SMALL_BUCKET:
                inside = self._rows.where(F.col("d").startswith(bucket))
                smallest = [r["d"] for r in inside.orderBy("d").limit(wanted + 1).collect()]
                if smallest[wanted] == smallest[wanted - 1]:
                    raise ValueError(SHARED_KEY.format(n))
                return smallest[wanted - 1]
            if bucket == prefix:
                raise ValueError(SHARED_KEY.format(n))
            prefix = bucket

    def _locate(self, prefix: str, wanted: int) -> tuple[str, int]:
        """The bucket that holds the wanted rank."""
        seen = 0
        for bucket, count in self._level(prefix):
            seen += count
            if seen >= wanted:
                return bucket, count
        raise AssertionError("rank beyond the counted rows")


def biggest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group; counts with map-side combine."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def running_offsets(
    counts: DataFrame, group: Sequence[str], bucket: str, values: Sequence[str]
) -> DataFrame:
    """(group.., bucket, <value>_offset): sums of the values over earlier buckets of the group."""
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *group, bucket, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_offset") for v in values]
    )


def digest_rank(
    df: DataFrame, digest_column: str, group: Sequence[str] = (), rank_column: str = "pos"
) -> DataFrame:
    """Zero-based rank of a row in digest order inside its group.

    Groups of up to ``WINDOW_ROWS`` rows are one window each. With a larger group
    the windows are (group, leading digits), as many digits as it takes, and the
    rows of earlier buckets are added.
    """
    group = list(group) or [ONE_GROUP]
    if group == [ONE_GROUP]:
        df = df.withColumn(ONE_GROUP, F.lit(0))
    biggest = biggest_group(df, group)
    digits = 0
    while biggest > WINDOW_ROWS * 16**digits:
        digits += 1
    keys = [*group, BUCKET] if digits else group
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(digest_column)) - 1
    if not digits:
        return df.withColumn(rank_column, inside.cast("bigint")).drop(ONE_GROUP)
    bucketed = df.withColumn(BUCKET, F.substring(digest_column, 1, digits))
    counts = bucketed.groupBy(*keys).agg(F.count("*").alias("rank__rows"))
    offsets = running_offsets(counts, group, BUCKET, ["rank__rows"])
    return (
        join_on(bucketed, offsets, keys)
        .withColumn(rank_column, inside + F.col("rank__rows_offset"))
        .drop(BUCKET, "rank__rows_offset", ONE_GROUP)
    )


def _place(order: Column, cuts: Column, low: int, high: int) -> Column:
    """Number of cuts below ``order`` by halving: few comparisons per row."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(order > cuts[middle], _place(order, cuts, middle + 1, high)).otherwise(
        _place(order, cuts, low, middle)
    )


def cumulative_before(
    df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], size_from: DataFrame | None = None
) -> DataFrame:
    """For each row the totals of ``values`` over rows of its group that sort earlier.

    ``order`` must be distinct inside a group (aggregate first). While a group is
    larger than ``WINDOW_ROWS`` it is cut at approximate quantiles into pieces
    that are ranked on their own; the cut points steer balance only, the totals
    are exact. Sizes and quantiles may be taken ``size_from`` rows that are cheaper
    to read.
    """
    source = df if size_from is None else size_from
    return _cumulative(df, list(group), order, list(values), source, biggest_group(source, group), 0)


def _cumulative(
    df: DataFrame, group: list[str], order: str, values: list[str], source: DataFrame, biggest: int, level: int
) -> DataFrame:
    if biggest <= WINDOW_ROWS or level == MOST_LEVELS:
        earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values})
    share = [i / PIECES for i in range(1, PIECES)]
    cuts = source.groupBy(*group).agg(F.percentile_approx(order, share, 1000).alias("cuts"))
    name = f"piece{level}"
    place = F.coalesce(_place(F.col(order), F.col("cuts"), 0, PIECES - 1), F.lit(0))
    located = join_pinned(df, cuts, group, CUT_GROUPS).withColumn(name, place).drop("cuts")
    keys = [*group, name]
    totals = located.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    offsets = running_offsets(totals, group, name, values)
    ranked = _cumulative(located, keys, order, values, located, biggest_group(located, keys), level + 1)
    return (
        join_on(ranked, offsets, keys)
        .withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"{v}_offset") for v in values})
        .drop(name, *[f"{v}_offset" for v in values])
    )


def dense_codes(values: DataFrame, order: str, code: str = "code", group: Sequence[str] = ()) -> DataFrame:
    """``values`` (distinct in group and ``order``) with their places from 0 in each group.

    Values are dealt into ranges, ranked inside each, and the values of earlier ranges are added. The ranges
    come from a bounded sample, as many as it takes for one to fit a window; they steer balance only.
    """
    group = list(group)
    total = values.count()
    pieces = min(MOST_PIECES, -(-total // max(1, WINDOW_ROWS // 4)))
    cuts = _sampled_cuts(values, order, total, pieces) if pieces > 1 else []
    kind = values.schema[order].dataType
    piece = _place(F.col(order), [F.lit(c).cast(kind) for c in cuts], 0, len(cuts))
    placed = values.withColumn("piece", piece.cast("int"))
    keys = [*group, "piece"]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("rows"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    offsets = running_offsets(counts, group, "piece", ["rows"]) if group else _offsets_of_all(counts)
    ranked = placed.withColumn("inside", inside)
    joined = join_on(ranked, offsets, keys)
    return joined.withColumn(code, (F.col("inside") + F.col("rows_offset")).cast("int")).drop(
        "piece", "inside", "rows_offset"
    )


def _offsets_of_all(counts: DataFrame) -> DataFrame:
    """Running offsets of one group: at most ``MOST_PIECES`` counts."""
    one = counts.withColumn(ONE_GROUP, F.lit(0))
    return running_offsets(one, [ONE_GROUP], "piece", ["rows"]).drop(ONE_GROUP)


def _sampled_cuts(values: DataFrame, order: str, total: int, pieces: int) -> list:
    """Values that cut the domain into about equal ranges, from about ``CUT_SAMPLE`` of them picked by digest."""
    picked = uniform(F.md5(F.col(order).cast("string"))) < F.lit(CUT_SAMPLE / total)
    found = sorted({r[0] for r in values.where(picked).select(order).collect()})
    return sorted({found[i * len(found) // pieces] for i in range(1, pieces)}) if found else []
