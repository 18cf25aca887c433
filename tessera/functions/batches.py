"""Batches of rows to Python workers: bounded by rows and bytes, so a worker's memory does not grow with the input."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes in one Arrow batch to Python, whichever comes first; one longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits to ``BATCH_ROWS`` and ``BATCH_BYTES``; Spark reads both when it plans a query, so they stay so."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
