"""Helpers around the session: lineage cuts and table reads."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch between Spark and Python, where the session has not set another number than
#: Spark's own: rows that hold whole texts are large, and each worker holds some batches at a time.
ARROW_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Gives the session's Python stages batches of ``ARROW_ROWS`` rows, unless it asks for another number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; only Spark's reader touches the path."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class SharedFolderError(RuntimeError):
    """A cluster names no folder that all its machines see."""


def _shared(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or the one set before; a local session without either
    gets a temporary one, a cluster an error, as its machines would each write to their own disks."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise SharedFolderError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    base = _shared(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/tidemark-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared checkpoint folder: for wide rows, which compress well."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more.

    It does so only when the driver collects garbage, which a job of many small steps would
    otherwise do too late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
