"""Batches of whole texts that travel to Python are bounded in bytes."""

from pyspark.sql import SparkSession

MAX_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one batch, or one longer row.  Spark's own bound is 10,000 rows, which long texts turn into any size.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """Fill the session's byte limit of Arrow batches; a limit that is set already wins."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(MAX_BYTES, None) is None:
        spark.conf.set(MAX_BYTES, str(BATCH_BYTES))
