"""Arrow batches of bounded size, for operators that work on whole texts in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one batch that goes to a Python worker, and rows of it.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes; a smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer splits than there are: a small table in one row group is else one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
