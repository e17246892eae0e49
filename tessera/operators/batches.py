"""Bounds of what a Python worker is given at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch from which on no further row joins it.
BATCH_BYTES = 32 << 20


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the Arrow batches that hold whole texts, by rows and by bytes; a longer text is a batch of its own. The session's own limits
    stay if smaller. They have to stay set, for plans read them when they run."""
    rest = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rest <= 0 or rest > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
