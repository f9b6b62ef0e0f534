"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: A word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    tasks run in the driver's own process, may leave it unset; a temporary folder
    is used then.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="smudgelab-llm-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage, survives lost executors, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, or a longer name where a column of that name exists in any case."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without input columns that clash with the columns an operator adds."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of whole rows of about this size, so that Python workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_memory_back() -> None:
    """Returns a Python worker's free memory to the system, where its allocators can.

    Workers wait between tasks and keep what they once took, next to those of other stages.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def whole_texts(column: Column) -> Column:
    """A text, empty where it is null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def sampled(df: DataFrame, keys: Sequence[str | Column], wanted: int, purpose: str) -> DataFrame:
    """``wanted`` rows of ``df`` (all, if fewer): those with the smallest hashes of their keys.

    Rows are thinned out by the hash first, to about twice as many as wanted, so that little
    comes together wherever the input's partitions are many. Reruns agree.
    """
    total = df.count()
    drawn = F.xxhash64(*keys, F.lit(purpose))
    cells = 1 << 40
    rate = min(1.0, (2.0 * wanted + 100) / max(1, total))
    thinned = df.where(F.pmod(drawn, F.lit(cells)) < int(rate * cells))
    return thinned.orderBy(F.pmod(drawn, F.lit(cells)), *keys).limit(wanted)
