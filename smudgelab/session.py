"""Session settings used by the entry point, the tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str, cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    shuffle = os.environ.get("SMUDGELAB_SHUFFLE_PARTITIONS", "8")
    spark = (
        builder.config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder for tables that cut lineage, shared by driver and executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, which has
    no other executors, may leave that unset; it gets a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
    spark.conf.set(CHECKPOINT_SETTING, tempfile.mkdtemp(prefix="smudgelab-"))
    return spark.conf.get(CHECKPOINT_SETTING)
