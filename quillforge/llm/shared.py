"""The folder that driver and executors share, and lineage cut there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in a single process, as in tests, a folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not (own := getattr(spark.sparkContext, "_own_shared_dir", None)):
        own = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext._own_shared_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


#: Bytes of one batch that goes to a Python worker: several copies of it are alive at once, in the executor and in the worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, since rows hold whole texts or packed arrays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder; a lost executor costs no more than that read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go as each execution ends; else they stay until the driver happens to collect its garbage.
    What is kept beyond an execution must be cut() or written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Tables:
    """Parquet tables of one query in the shared folder, for what is too large to keep as rows or is read more than once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
