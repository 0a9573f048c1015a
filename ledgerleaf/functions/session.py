"""Session helpers: local sessions and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache, wraps
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "ledgerleaf", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Settings of every run: split long projections, bounded batches for Python.

    Arrow batches are bounded in bytes, as rows may hold very long texts. Methods above 8000 bytes of byte code are never compiled by the JVM. Beyond that
    size Spark's split projections run several times faster than one fused method. Folders and
    files are listed by a few tasks for each core; by default every folder, up to 10,000, is a task.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    listers = max(32, 4 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(listers))
    return spark


def once[T](build: Callable[[], T]) -> Callable[[], T]:
    """Columns that depend on no table, built once for a Spark context.

    They are unresolved, so any table may use them. Thousands of calls to the JVM make the columns of
    an ingestion, which took longer than the work in a stream of small batches.
    """
    built: WeakKeyDictionary[SparkContext, T] = WeakKeyDictionary()

    @wraps(build)
    def get() -> T:
        context = SparkContext._active_spark_context
        if context not in built:
            built[context] = build()
        return built[context]

    return get


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerleaf-")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir``.

    A temporary folder is taken only by a session on one machine, as in tests; on a
    cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return _own_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/ledgerleaf-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back.

    For results that must not be computed twice, such as calls to a paid model.
    The lineage ends at the files, so a lost executor does not repeat the calls.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
