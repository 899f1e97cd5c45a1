"""Bounds on what one Arrow batch carries to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes too, so that very long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
