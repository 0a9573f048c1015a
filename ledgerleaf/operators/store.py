"""Vector table: payload checks, record ids and idempotent upserts.

Layout: versions of parquet (see :mod:`ledgerleaf.operators.snapshots`), partitioned by ``workspace_id`` and ``bucket``. The bucket is a
hash of the document id, so that a large workspace is spread over many
partitions while a document stays in one of them: a scoped search and a document
replacement both touch few partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions import ids, text
from ledgerleaf.operators import snapshots

DEFAULT_BUCKETS = 64
COLUMNS = (
    "record_id", "document_id", "document_type", "chunk_id", "chunk_index",
    "embedding_model", "vector_dimensions", "vector", "text_content",
)
PARTITIONS = ("workspace_id", "bucket")


def bucket_of(document_id: Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(text.strip(document_id)), F.lit(buckets)).cast("int")


def payload_errors(vectors: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """First payload error of every document that has one: reason and position.

    ``vectors`` holds workspace_id, document_id, document_type, chunk_id,
    chunk_index, vector and dimensions. A document is rejected as a whole.
    Everything is a plain aggregate with map-side combining, so one document that
    holds a third of the rows does not land in one task.
    """
    keys = ["workspace_id", "document_id"]
    rows = vectors.select(
        *keys, "chunk_index",
        text.strip(F.col("chunk_id")).alias("cid"),
        F.coalesce(F.size("vector"), F.lit(0)).alias("n"),
        F.col("dimensions").alias("expected"),
    )
    blank_cid = F.coalesce(F.col("cid") == "", F.lit(True))
    found = lambda rank, reason: F.struct(
        "chunk_index", F.lit(rank).alias("rank"), F.lit(reason).alias("reason")
    )
    per_row = rows.select(
        *keys,
        F.when(blank_cid, found(1, "missing_chunk_id"))
        .when(F.col("n") <= 0, found(3, "empty_vector"))
        .when((F.col("expected") > 0) & (F.col("n") != F.col("expected")), found(4, "dimension_mismatch"))
        .alias("found"),
    ).filter("found is not null")

    # A repeated chunk id fails where it is met for the second time.
    at = rows.filter(~blank_cid).groupBy(*keys, "cid", "chunk_index").agg(F.count("*").alias("n"))
    repeated = (
        at.groupBy(*keys, "cid")
        .agg(F.sum("n").alias("total"), F.min(F.struct("chunk_index", "n")).alias("first"))
        .filter("total > 1")
    )
    again = (
        at.join(repeated.select(*keys, "cid", "first"), [*keys, "cid"])
        .filter((F.col("chunk_index") > F.col("first.chunk_index")) | (F.col("first.n") > 1))
        .select(*keys, found(2, "duplicate_chunk_id").alias("found"))
    )
    worst = per_row.unionByName(again).groupBy(*keys).agg(F.min("found").alias("found"))

    heads = vectors.groupBy(*keys).agg(
        F.max(text.is_blank(F.col("document_type"))).alias("no_type"), F.lit(True).alias("has_vectors")
    )
    if documents is not None:
        listed = documents.groupBy(*keys).agg(F.max(text.is_blank(F.col("document_type"))).alias("no_type"))
        heads = (
            listed.unionByName(heads.select(*keys, "no_type", "has_vectors"), allowMissingColumns=True)
            .groupBy(*keys)
            .agg(F.max("no_type").alias("no_type"), F.max("has_vectors").alias("has_vectors"))
        )
    reason = (
        F.when(text.is_blank(F.col("h.workspace_id")), "missing_workspace_id")
        .when(text.is_blank(F.col("h.document_id")), "missing_document_id")
        .when(F.col("no_type"), "missing_document_type")
        .when(F.col("has_vectors").isNull(), "no_vectors")
        .otherwise(F.col("found.reason"))
    )
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    return (
        heads.alias("h")
        .join(worst.alias("w"), same, "left")
        .select(
            "h.workspace_id", "h.document_id",
            reason.alias("reason"),
            F.when(reason == F.col("found.reason"), F.col("found.chunk_index")).alias("position"),
        )
        .filter("reason is not null")
    )


def records(vectors: DataFrame, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Rows in the shape of the vector table."""
    part = lambda n: text.strip(F.col(n)).alias(n)
    return vectors.select(
        ids.record_id(F.col("workspace_id"), F.col("document_id"), F.col("chunk_id")).alias("record_id"),
        part("document_id"), part("document_type"), part("chunk_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "embedding_model",
        F.col("dimensions").alias("vector_dimensions"),
        "vector", "text_content",
        part("workspace_id"),
        bucket_of(F.col("document_id"), buckets).alias("bucket"),
    )


#: Record ids alone are ambiguous: parts may hold the mark that joins them.
KEY = ["workspace_id", "document_id", "record_id"]


def newest(rows: DataFrame, version: str | None = None) -> DataFrame:
    """One row per record id. A limit of 1 per group runs before the shuffle."""
    order = [F.col(version).desc()] if version else []
    w = Window.partitionBy(*KEY).orderBy(*order, F.col("chunk_index"), F.col("text_content"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _merge(existing: DataFrame, batch: DataFrame, replace_document: bool) -> DataFrame:
    key = ["workspace_id", "document_id"] if replace_document else KEY
    kept = existing.join(batch.select(*key), key, "left_anti")
    return kept.unionByName(batch.select(*kept.columns))


def merged(
    existing: DataFrame, new: DataFrame, *, version: str | None = None, replace_document: bool = False
) -> DataFrame:
    """Table content after an upsert of ``new`` into ``existing``.

    A small batch is broadcast by the planner, and then the existing rows are not
    shuffled at all. ``replace_document`` also drops stale chunks of the documents
    in the batch.
    """
    return _merge(existing, newest(new, version), replace_document)


def upsert(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    *,
    version: str | None = None,
    replace_document: bool = False,
    ledger: tuple[str, int] | None = None,
) -> int:
    """Upsert table rows (see :func:`records`) into the vector table at ``path``; the number of its version.

    Of the touched partitions only keys are read, and parts with rows that the batch replaces are
    written anew, as a new version (see :mod:`ledgerleaf.operators.snapshots`). ``ledger`` is the stream and number of a batch that
    may be delivered twice.
    """
    batch = newest(new, version).select(*COLUMNS, *PARTITIONS)
    merge = lambda here, rows: _merge(here, rows, replace_document)
    keys = KEY[:2] if replace_document else KEY
    return snapshots.upsert(spark, path, batch, list(PARTITIONS), merge, ledger, keys).number


def table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The vector table as of a version, by default the last one."""
    return snapshots.read(spark, path, version)


def upsert_summary(rows: DataFrame) -> DataFrame:
    """Stored record count per document, counted before the shuffle."""
    return rows.groupBy("workspace_id", "document_id").agg(F.count("*").alias("stored_count"))


def upserted_ids(rows: DataFrame) -> DataFrame:
    """The record ids of every document as rows of their own, so a document of any size fits."""
    return rows.select("workspace_id", "document_id", "record_id")
