"""Rendering, chunking, embedding, the vector table and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.functions.session import new_path
from ledgerleaf.functions.vectors import distance
from ledgerleaf.operators import approx, chunk, embed, retrieve, store
from ledgerleaf.sources.corpus import read, texts, with_exprs
from queries import fixtures as X


# --- E: text and chunks --------------------------------------------------------------
def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.validated(spark, sf_dir).withColumn("semantic_text", chunk.semantic_text(F.col("is_valid")))


def e1_semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("document_id", "semantic_text")


def _prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return chunk.chunks(docs, body="text")


def e2_overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose_chunks(spark, sf_dir).select("document_id", "chunk_index", "text_content")


def e3_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose_chunks(spark, sf_dir).select("document_id", "chunk_index", "chunk_id")


def e4_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(_rendered(spark, sf_dir).filter("is_valid")).select(
        "chunk_id", "workspace_id", "document_id", "document_type", "chunk_index", "total_chunks", "is_valid"
    )


def e5_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_stats(_rendered(spark, sf_dir))


def e6_input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("CASE WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 5 = 2 THEN NULL ELSE c_name END").alias("document_id"),
        F.expr("CASE WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN NULL ELSE c_mktsegment END").alias("workspace_id"),
    )
    return rows.select("c_custkey", chunk.prepare_error().alias("error"))


# --- F: embedding -----------------------------------------------------------------------
def f1_truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", embed.truncated(F.col("text")).alias("cut"))


def _embedded(spark: SparkSession, sf_dir: str, make, dimensions: int = X.DIMENSIONS) -> DataFrame:
    docs = texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("ws").alias("workspace_id"),
        F.col("text").alias("text_content"),
    )
    return embed.embed(docs, make, dimensions=dimensions, model="hashing")


def f2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir, embed.hashing_embedder(X.DIMENSIONS)).select(
        "document_id", "embedding_model", F.size("vector").alias("size"),
        # Adding zero takes the sign off a negative zero.
        (F.round(distance(F.col("vector"), F.col("vector"), "ip"), 4) + F.lit(0.0)).alias("self_distance"), "embed_error",
    )


def lossy_embedder():
    """Loses the last vector of every call that holds a certain word."""
    inner = embed.hashing_embedder(X.DIMENSIONS)()
    return lambda texts: inner(texts)[: len(texts) - any(t.startswith("Is ") for t in texts)]


def f3_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _embedded(spark, sf_dir, lambda: lossy_embedder())
    return bad.select("document_id", F.split("embed_error", ":")[0].alias("error"), F.col("vector").isNull().alias("lost"))


VECTOR_SIZE = "CASE WHEN vec_id % 7 = 3 THEN 0 WHEN vec_id % 7 = 5 THEN 63 ELSE 64 END"


def f4_dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", F.lit(1), F.expr(f"cast({VECTOR_SIZE} as int)")).alias("vector")
    )
    return cut.select("vec_id", embed.dimension_error(F.col("vector"), X.DIMENSIONS).alias("error"))


def f5_document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = X.vectors(spark, sf_dir).withColumn("embed_error", F.when(F.expr("vec_id % 251 = 3"), "empty_vector"))
    listed = read(spark, sf_dir, "nation").select(
        F.concat(F.lit("ws-"), (F.col("n_nationkey") % 2).cast("string")).alias("workspace_id"),
        F.concat(F.lit("label-"), F.col("n_nationkey").cast("string")).alias("document_id"),
    )
    return embed.document_summary(done, listed).select(
        "workspace_id", "document_id", "embedding_model", "total_chunks_processed",
        F.coalesce("vector_dimensions", F.lit(0)).alias("vector_dimensions"), "error",
    )


# --- G: vector table ------------------------------------------------------------------------
PAYLOAD_SQL = {
    "document_id": "CASE WHEN vec_id % 61 = 7 THEN ' ' ELSE concat('doc-', cast(vec_id % 61 as string)) END",
    "workspace_id": "CASE WHEN vec_id % 61 = 9 THEN '' ELSE concat('ws-', cast(vec_id % 61 % 4 as string)) END",
    "document_type": "CASE WHEN vec_id % 61 = 11 THEN NULL ELSE 'Receipt' END",
    "chunk_index": "cast(floor(vec_id / 61) as int)",
    "chunk_id": (
        "CASE WHEN vec_id % 61 = 13 AND floor(vec_id / 61) >= 2 THEN '  ' "
        "WHEN vec_id % 61 IN (15, 16) AND floor(vec_id / 61) IN (1, 3, 5) THEN ' same ' "
        "ELSE concat('c-', cast(vec_id as string)) END"
    ),
    "vector_size": (
        "CASE WHEN vec_id % 61 IN (16, 17) AND floor(vec_id / 61) >= 2 THEN 0 "
        "WHEN vec_id % 61 = 19 AND floor(vec_id / 61) = 4 THEN 60 ELSE 64 END"
    ),
}


def g1_payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_exprs(read(spark, sf_dir, "embeddings"), PAYLOAD_SQL).select(
        "workspace_id", "document_id", "document_type", "chunk_id", "chunk_index",
        F.slice("embedding", F.lit(1), F.col("vector_size").cast("int")).alias("vector"),
        F.lit(X.DIMENSIONS).alias("dimensions"),
    )
    listed = read(spark, sf_dir, "nation").select(
        F.lit("ws-x").alias("workspace_id"), F.col("n_name").alias("document_id"), F.lit("Receipt").alias("document_type")
    )
    return store.payload_errors(rows, listed).select(
        "workspace_id", "document_id", "reason", F.coalesce("position", F.lit(-1)).alias("position")
    )


def g2_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vectors(spark, sf_dir).select(
        "vec_id",
        ids.record_id(F.concat(F.lit(" "), "workspace_id"), F.col("document_id"), F.concat("chunk_id", F.lit(" "))).alias("record_id"),
    )


def _upsert_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored part and a batch that overlap; the batch holds two versions of some rows."""
    rows = X.vectors(spark, sf_dir)
    old = rows.filter("vec_id % 3 <> 0").withColumn("text_content", F.concat(F.lit("old "), "chunk_id"))
    batch = rows.filter("vec_id % 3 <> 1").withColumn("version", F.explode(F.expr("sequence(1, cast(1 + vec_id % 2 as int))")))
    batch = batch.withColumn("text_content", F.concat(F.lit("new "), "chunk_id", F.lit(" v"), F.col("version").cast("string")))
    return store.records(old), store.records(batch).withColumn(
        "version", F.regexp_extract("text_content", r" v(\d+)$", 1).cast("int")
    )


def g3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = _upsert_sides(spark, sf_dir)
    return store.merged(old, batch, version="version").select("record_id", "workspace_id", "text_content")


def g3_stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the stored table: two upserts, read back from the last version."""
    old, batch = _upsert_sides(spark, sf_dir)
    path = new_path(spark, "vectors")
    store.upsert(spark, old, path)
    store.upsert(spark, batch, path, version="version")
    return store.table(spark, path).select("record_id", "workspace_id", "text_content")


def g4_stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.records(X.vectors(spark, sf_dir)).select(
        "record_id", "workspace_id", "document_id", "document_type", "chunk_id", "chunk_index",
        "embedding_model", "vector_dimensions", "text_content", F.size("vector").alias("size"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vector_sum"),
    )


def g5_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_summary(store.records(X.vectors(spark, sf_dir)))


def g5_document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upserted_ids(store.records(X.vectors(spark, sf_dir)))


def g5_upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The checking SQL states blocks of 200 chunks, with their ids as one text; whole documents are in the two queries above.
    rows = X.vectors(spark, sf_dir).withColumn(
        "document_id", F.concat("document_id", F.lit("-"), F.floor(F.col("vec_id") / 200).cast("string"))
    )
    stored, key = store.records(rows), ["workspace_id", "document_id"]
    ids = store.upserted_ids(stored).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("record_id")), ",").alias("record_ids"))
    return store.upsert_summary(stored).join(ids, key)


# --- H: retrieval --------------------------------------------------------------------------
def h1_request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = X.faulty_questions(spark, sf_dir)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    total = rows.agg((F.max("vec_id") + 1).alias("n"))
    joined = asked.withColumn("n", total.scalar()).withColumn("vec_id", F.expr("(conv_id * 31 + turn) % n")).join(rows, "vec_id", "left").withColumn(
        "query_embedding",
        F.when(F.expr("conv_id % 13 = 8"), F.slice("embedding", 1, 10)).when(F.expr("conv_id % 13 <> 9"), F.col("embedding")),
    )
    return joined.select("query_id", retrieve.request_error(X.DIMENSIONS).alias("error"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.records(X.vectors(spark, sf_dir))


def h2_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _stored(spark, sf_dir).groupBy("workspace_id", "document_id").agg(F.count("*").alias("candidates"))
    return retrieve.in_scope(held, X.requests(spark, sf_dir)).select("query_id", "workspace_id", "document_id", "candidates")


def _hits(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return retrieve.top_k(_stored(spark, sf_dir), X.requests(spark, sf_dir), **options)


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", F.round("distance", 6).alias("distance"), "record_id")


def h3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_columns(_hits(spark, sf_dir))


def h3_exact_top_k_join_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_columns(_hits(spark, sf_dir, plan="join"))


def h3_exact_top_k_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_columns(_hits(spark, sf_dir, metric="cosine"))


def h4_approximate_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _stored(spark, sf_dir), X.requests(spark, sf_dir)
    centres = approx.fit_cells(rows, X.DIMENSIONS)
    found = approx.approx_top_k(approx.with_cell(rows, centres), asked, centres)
    return approx.recall(found, _hits(spark, sf_dir))


HIT_FAULTS = {
    "chunk_id": "CASE WHEN vec_id % 41 = 3 THEN NULL ELSE chunk_id END",
    "document_type": "CASE WHEN vec_id % 41 = 5 THEN ' ' ELSE document_type END",
    "chunk_index": "CASE WHEN vec_id % 41 = 7 THEN 'x' ELSE cast(chunk_index as string) END",
    "workspace_id": "CASE WHEN vec_id % 41 = 9 THEN 'ws-9' ELSE workspace_id END",
    "document_id": "CASE WHEN vec_id % 41 = 11 THEN 'label-77' ELSE document_id END",
}


def h5_hit_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumn("vec_id", F.col("chunk_index"))
    return retrieve.check_hits(with_exprs(hits, HIT_FAULTS), X.requests(spark, sf_dir))


def h6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = X.requests(spark, sf_dir)
    hits = retrieve.top_k(_stored(spark, sf_dir), asked)
    return hits.join(retrieve.totals(hits, asked), "query_id").select(
        "query_id", "rank", "chunk_id", "document_id", "workspace_id", "chunk_index", "document_type",
        "text_content", "total_results",
    )


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "efgh" and n[1:2].isdigit()}
