"""Question answering and whole-run operators."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text, values
from ledgerleaf.functions.session import new_path, saved
from ledgerleaf.operators import ask, embed, retrieve, store
from ledgerleaf.plans import ingest, reports, resume
from ledgerleaf.sources import corpus
from ledgerleaf.sources.corpus import read, texts
from ledgerleaf.streaming import arrivals
from queries import fixtures as X


# --- I: questions -------------------------------------------------------------------------
def i1_question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.faulty_questions(spark, sf_dir).select(
        "query_id",
        ask.question_error().alias("error"),
        F.size(ask.drop_blank_ids(F.col("selected_document_ids"))).alias("usable_ids"),
    )


def i2_question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ask.embed_questions(X.questions(spark, sf_dir), embed.hashing_embedder(X.DIMENSIONS), X.DIMENSIONS)
    return done.select("query_id", F.size("query_embedding").alias("size"), "embed_error")


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and their hits."""
    asked = X.requests(spark, sf_dir)
    return asked, retrieve.top_k(store.records(X.vectors(spark, sf_dir)), asked)


def i3_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.contexts(_searched(spark, sf_dir)[1]).select("query_id", "context")


def i4_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _searched(spark, sf_dir)
    return ask.with_context(asked, hits).filter("prompt is not null").select("query_id", "prompt")


def i5_no_hit_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of odd conversations ask for documents that nobody stored."""
    asked, hits = _searched(spark, sf_dir)
    hits = hits.filter("query_id % 2000 < 1000")
    replied = ask.generate(ask.with_context(asked, hits), lambda: ask.echo_generator())
    return replied.filter("total_sources_retrieved = 0").select("query_id", "answer")


def i6_generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _searched(spark, sf_dir)
    replied = ask.generate(ask.with_context(asked, hits), lambda: ask.echo_generator())
    return replied.select("query_id", "answer", "answer_error")


def i7_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.source_rows(_searched(spark, sf_dir)[1]).withColumn("distance", F.round("distance", 6))


def i8_answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _searched(spark, sf_dir)
    return ask.with_context(asked, hits).select(
        "query_id",
        text.strip(F.col("query")).alias("query"),
        F.coalesce(F.array_join(F.transform("source_chunks", lambda s: s["chunk_id"]), ","), F.lit("")).alias("sources"),
        "total_sources_retrieved",
    )


def i9_scoped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: total of two thirds of their documents, the rest is left out."""
    docs = X.extracted(spark, sf_dir).select(
        "workspace_id", "document_id", "key", values.amount(F.col("totals.grand_total")).alias("total_amt")
    )
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr(corpus.PART).alias("part")).distinct()
    heads = read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 1").join(parts, "o_orderkey", "left").withColumn("part", F.coalesce("part", F.lit(0))).select(
        F.col("o_custkey").alias("query_id"),
        F.concat(F.lit("ws-"), F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0")).alias("workspace_id"),
        F.array(F.concat(F.lit("doc-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.expr(corpus.PART_SUFFIX))).alias("selected_document_ids"),
    )
    return ask.scoped_totals(heads, docs).select(
        "query_id", "workspace_id", F.col("total").cast("double").alias("total"), "documents_with_total", "documents_selected"
    )


# --- J: whole runs ----------------------------------------------------------------------------
def _faulty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fail in each stage that can: refused at upload, not parsed,
    invalid, without an identifier (prepare), with a vector of another size (embed), listed twice (store)."""
    reject = F.when(F.expr("key % 37 = 3"), "Uploaded file is empty.")
    lost = F.when(F.expr("key % 37 = 5"), "corrupted_csv")
    blank = F.when(F.expr("key % 37 = 7"), " ").otherwise(F.col("workspace_id"))
    docs = X.documents(spark, sf_dir).withColumns({"reject_reason": reject, "parse_error": lost, "workspace_id": blank})
    nameless = F.when(F.expr("key % 37 = 11"), "").otherwise(F.col("document_id"))
    twice = F.explode(F.expr("sequence(1, CASE WHEN key % 37 = 17 THEN 2 ELSE 1 END)"))
    return docs.withColumn("document_id", nameless).withColumn("copy", twice).drop("copy")


def _whole_run(spark: SparkSession, sf_dir: str, vector_path: str | None = None) -> ingest.Ingested:
    """All eight stages over documents that fail in each of them."""
    return ingest.ingest(_faulty_documents(spark, sf_dir), X.faulty_embedder, dimensions=X.SMALL, vector_path=vector_path)


def j1_resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, the second with all documents: the same rows as of one run over all."""
    docs = saved(_faulty_documents(spark, sf_dir), "documents")
    options = {"state_path": new_path(spark, "state"), "vector_path": new_path(spark, "vectors"), "dimensions": X.SMALL, "buckets": 4}
    for part in (docs.filter("key % 3 <> 1"), docs):
        out, _ = resume.ingest_changed(part, X.faulty_embedder, **options)
    return out


def j1_staged_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_run(spark, sf_dir).results.select("document_id", "failed_stage", "success")


def j1_stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run has left in the vector table: documents that passed all eight stages."""
    path = new_path(spark, "vectors")
    _whole_run(spark, sf_dir, path)
    return store.upsert_summary(store.table(spark, path))


def j2_stage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_run(spark, sf_dir).audit.select("document_id", "stage_no", "tool_name", "success", "error")


def j2_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tasks of a whole run counted while they wrote, without another look at the tables."""
    return _whole_run(spark, sf_dir).steps.select("step", "counter", "value")


def j3_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_run(spark, sf_dir).results


def j3_question_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = X.faulty_questions(spark, sf_dir).withColumn(
        "error", F.coalesce(ask.question_error(), retrieve.request_error(check_vector=False))
    )
    return ask.results(checked)


def j4_arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, then ingested by a stream, twice with one checkpoint."""
    inbox, state, out = (new_path(spark, x) for x in ("inbox", "state", "parsed"))
    body = F.concat(F.lit("RECEIPT\n"), F.col("text"))
    texts(spark, sf_dir).select(body.alias("value")).write.option("lineSep", "\x1f").option(
        "maxRecordsPerFile", 50
    ).text(inbox)
    for _ in range(2):
        arrivals.ingest_arrivals(
            spark, inbox + "/part-*.txt", state,
            lambda docs, n: docs.withColumn("batch", F.lit(n)).write.mode("append").parquet(out),
            workspace_id="ws-arrivals", max_files=100,
        ).awaitTermination()
    return spark.read.parquet(out).groupBy("workspace_id", "parsing_status").agg(
        F.countDistinct("document_id").alias("documents"), F.count("*").alias("rows")
    )


class _Lost(Exception):
    """The process ends between the commit of the vectors and the commit of the stream."""


def j4_arriving_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ten customers each go through a stream into the vector table: killed after the first commit, run again, and once more."""
    inbox, state, vectors = (new_path(spark, x) for x in ("inbox", "state", "vectors"))
    group = F.floor(F.col("o_custkey") / 10).alias("k")
    kind = F.when(F.col("k") % 7 == 3, "INVOICE").otherwise("RECEIPT")
    rows = read(spark, sf_dir, "orders").select(group, "o_orderkey", "o_custkey")
    line = F.concat(kind, F.lit(" of order "), F.col("o_orderkey").cast("string"), F.lit(" for customer "), F.col("o_custkey").cast("string"))
    rows.repartition("k").sortWithinPartitions("k", "o_orderkey").select("k", line.alias("value")).write.partitionBy("k").text(inbox)

    def die(_: ingest.Ingested, batch_id: int) -> None:
        raise _Lost(batch_id)

    for on_run in (die, None, None):
        run = arrivals.ingest_into(
            spark, inbox, state, vectors, embed.hashing_embedder(X.SMALL), workspace_id="ws-arrivals", max_files=2000, dimensions=X.SMALL, on_run=on_run
        )
        try:
            run.awaitTermination()
        except StreamingQueryException as exc:
            if "_Lost" not in str(exc):
                raise
    # The identifier depends on the path of the file; an overlap may begin within it.
    named = F.regexp_replace("text_content", r"[0-9a-f-]+\nValidation", "x\nValidation")
    return store.table(spark, vectors).select("document_type", "chunk_index", named.alias("text_content"))


def j5_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return reports.latency_summary(audit).withColumn("avg_ms", F.round("avg_ms", 6))


def j6_workspace_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers whose joined forms are equal, ``a`` / ``b:c`` and ``a:b`` / ``c``, are told apart."""
    clash = lambda c, x, y: F.when(F.expr("vec_id % 3 = 0"), x).when(F.expr("vec_id % 3 = 1"), y).otherwise(F.col(c))
    rows = X.vectors(spark, sf_dir)
    rows = rows.withColumns({"workspace_id": clash("workspace_id", "a", "a:b"), "document_id": clash("document_id", "b:c", "c")})
    scope = lambda x, y: F.when(F.expr("floor(query_id / 1000) % 2 = 0"), x).otherwise(y)
    asked = X.requests(spark, sf_dir).withColumns({"workspace_id": scope("a", "a:b"), "selected_document_ids": F.array(scope("b:c", "c"))})
    hits = retrieve.top_k(store.records(rows), asked)
    wrong = reports.foreign_rows(hits, asked).groupBy("query_id").agg(F.count("*").alias("foreign"))
    seen = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.max(F.col("chunk_index") % 3).alias("side"))
    return seen.join(wrong, "query_id", "left").select("query_id", "hits", "side", F.coalesce("foreign", F.lit(0)).alias("foreign"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "ij" and n[1:2].isdigit()}
