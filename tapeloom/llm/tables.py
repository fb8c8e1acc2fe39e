"""Session settings, the shared folder and small table helpers of the text operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # whole texts travel in Arrow batches: bound them by bytes, not only by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the text operators rely on, and let local Python workers find this package."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH", "")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a session without that setting (tests, one machine) gets a temporary folder of its own. The folder is
    removed when the driver ends.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if top is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/text-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps no longer depend on its lineage.

    The shuffle files behind it are of no more use; Spark's cleaner removes them once the driver collects its garbage,
    which is asked for here, so that the disks hold one step's shuffles and not those of a whole query.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; whatever else a table holds, under whatever name, stays outside."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def row_key() -> Column:
    """Tells rows apart by id and text: repeated rows share it, and get the same results."""
    return F.xxhash64("doc_id", "text").alias("row_key")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
