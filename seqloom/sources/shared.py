"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, local mode gets one of its own; a cluster,
    whose machines share no temporary folder, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/seqloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost no rerun of what came before."""
    path = f"{_own(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes this application's tables in the shared folder; call it when their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
