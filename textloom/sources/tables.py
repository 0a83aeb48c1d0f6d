"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker is sent at once.
BATCH = 6 << 20
_local: dict[str, str] = {}
_paths: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of a local master where it is unset, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that its lineage ends there and no executor's loss recomputes it."""
    spark = df.sparkSession
    df.write.parquet(path := f"{folder(spark)}/textloom-{uuid.uuid4().hex}")
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def slim_batches(spark: SparkSession) -> None:
    """Has workers get rows in small batches from now on, as results are computed when the caller asks. By rows alone a batch
    is ten thousand of them, so a worker's memory would grow with the table until its tasks hold as many, and with the texts."""
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables; to be called when no result is needed any more."""
    while _paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
