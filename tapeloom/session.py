"""Spark session settings shared by tests, benchmarks and jobs."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a tile fits in memory: do not move its rows to a spillable sorter after the default 4096
    "spark.sql.windowExec.buffer.in.memory.threshold": "65536",
    # the JVM does not compile methods over 8000 bytes: wide stages run faster in split projections
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


ROOT = str(Path(__file__).resolve().parents[1])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on to an existing session; local Python workers find this package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH", "")]))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without one (tests) gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
