"""Incremental ingestion of arriving files as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerleaf.functions import text
from ledgerleaf.functions.session import once
from ledgerleaf.operators import embed
from ledgerleaf.plans import ingest
from ledgerleaf.sources import admit, decode

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of files below ``path``; each file is delivered once."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )


@once
def _named() -> dict[str, Column]:
    name = admit.base_name(F.col("path"))
    return {"filename": name, "mime_type": admit.guess_mime(name)}


def as_uploads(files: DataFrame, workspace_id: str) -> DataFrame:
    """Uploads named and typed by their path."""
    return files.withColumn("workspace_id", F.lit(workspace_id)).withColumns(_named())


def parsed_batch(files: DataFrame, workspace_id: str) -> DataFrame:
    """Documents of a batch from one scan, stable ids included: parsed ones, and refused files with their reason."""
    named = admit.checked(as_uploads(files, workspace_id)).withColumn("document_id", admit.document_id())
    mime = F.lower(text.strip(F.col("mime_type")))
    return decode.parse_files(named.withColumn("mime_type", mime).withColumnRenamed("length", "file_size"))


def ingest_arrivals(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    *,
    workspace_id: str,
    max_files: int = 1000,
) -> StreamingQuery:
    """Run ``handle(parsed documents, batch id)`` on every micro-batch of new files.

    Document ids depend on content only, and the vector table is upserted, so a batch
    that is repeated after a failure leaves the same rows.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        handle(parsed_batch(batch, workspace_id), batch_id)

    return (
        arriving_files(spark, path, max_files)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_into(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    vector_path: str,
    make_embedder: Callable[[], embed.Embedder],
    *,
    workspace_id: str,
    stream: str | None = None,
    max_files: int = 1000,
    on_run: Callable[[ingest.Ingested, int], None] | None = None,
    **options,
) -> StreamingQuery:
    """All stages over every micro-batch of new files; the vectors end in the table at ``vector_path``.

    Exactly once: the number of the batch is committed together with its vectors. If the
    process ends before that, the batch runs again on the version before; if it ends between
    that and the commit of the stream, the repeated batch finds its number and changes nothing.
    ``stream`` names the stream in the table's ledger, by default its checkpoint; ``on_run``
    sees the tables of each run after its commit; ``options`` go to :func:`ingest.ingest`.
    """

    def handle(docs: DataFrame, batch_id: int) -> None:
        done = ingest.ingest(docs, make_embedder, vector_path=vector_path, ledger=(stream or checkpoint, batch_id), **options)
        if on_run is not None:
            on_run(done, batch_id)

    return ingest_arrivals(spark, path, checkpoint, handle, workspace_id=workspace_id, max_files=max_files)
