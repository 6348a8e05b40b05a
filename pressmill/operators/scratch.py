"""Intermediate tables in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_BYTES = 32 << 20


def folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only a local session may lack that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return f"{sc.getCheckpointDir()}/scratch/{sc.applicationId}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole pages to Python in batches of at most ``rows``; a smaller number stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet, to be read more than once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's tables, when all results are written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder(spark).rpartition("/")[0])
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
