"""Memory and disk that finished tasks and jobs hold."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.functions.session import new_path

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def returned(task: Task) -> Task:
    """The same task; what it held goes back to the machine when it ends or fails."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame, label: str, into: list[str] | None = None) -> DataFrame:
    """A table written once to the shared folder and read back; what its making has left in the executors' folders goes.

    ``into`` takes the path, for :func:`drop` when later tables have been written from it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if into is not None:
        into.append(path)
    settle(spark)
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing will read again."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()
