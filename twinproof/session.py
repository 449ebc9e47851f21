"""Session settings that every job relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Canonical row text depends on these, so both sides of a comparison must run under them.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    # Decides, among others, how a decimal reads as text: 0.00000000 or 0E-8.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    """Apply the pinned runtime settings to an existing session."""
    for key, value in PINNED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("twinproof")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables that must outlive a lost executor.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        parent = tempfile.mkdtemp(prefix="twinproof-")
    return f"{parent.rstrip('/')}/twinproof/{label}-{uuid.uuid4().hex}"
