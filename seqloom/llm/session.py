"""Session settings and shared-folder tables for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.shared import shared_dir, stored

__all__ = ["shared_dir", "small_batches", "stored"]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Texts are large rows: no more than so many rows, and about so many bytes, go to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
