"""Input relations of the registered queries, all derived from the given tables.

The ``*_SQL`` strings are plain expressions that the checking SQL shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.classify import classify
from ledgerleaf.operators.extract import extract
from ledgerleaf.operators.validate import validate
from ledgerleaf.sources import corpus
from ledgerleaf.sources.corpus import read, texts, with_exprs

DIMENSIONS = 64

# --- file names, types and sizes --------------------------------------------------
MANIFEST_SQL = {
    "filename": (
        "CASE CAST(doc_id % 14 AS INT) WHEN 0 THEN concat('../in/Invoice ', cast(doc_id as string), '.PDF') "
        "WHEN 1 THEN 'report.exe.pdf' WHEN 2 THEN '.hidden.txt' WHEN 3 THEN 'noext' "
        "WHEN 4 THEN 'scan (3).tiff' WHEN 5 THEN 'sheet.xlsx' WHEN 6 THEN 'data.CSV' "
        "WHEN 7 THEN 'a/b/photo.JPEG' WHEN 8 THEN 'archive.tar.gz' WHEN 9 THEN 'run.sh' "
        "WHEN 10 THEN 'ends.with.dot.' WHEN 11 THEN 'größe.docx' WHEN 12 THEN '..' "
        "ELSE 'notes.v1.txt' END"
    ),
    "mime_type": (
        "CASE WHEN doc_id % 5 = 1 THEN ' Text/Plain ' WHEN doc_id % 11 = 3 THEN 'video/mp4' "
        "ELSE CASE CAST(doc_id % 14 AS INT) WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/pdf' "
        "WHEN 4 THEN 'image/tiff' WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' "
        "WHEN 6 THEN 'text/csv' WHEN 7 THEN 'image/jpeg' WHEN 8 THEN 'application/gzip' "
        "WHEN 11 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' "
        "ELSE 'text/plain' END END"
    ),
    "length": (
        "CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 1 THEN n_chars + 10485761 ELSE n_chars END"
    ),
    "workspace_id": "concat('ws-', cast(doc_id % 7 as string))",
    "path": "concat('store/', cast(doc_id as string))",
}


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_exprs(texts(spark, sf_dir).select("doc_id", "n_chars", "text"), MANIFEST_SQL)


# --- documents through the stages ---------------------------------------------------
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.business_documents(spark, sf_dir)


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose table as one-page documents without tables."""
    from ledgerleaf import schemas

    page = F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text"))
    return texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.array(page).cast(schemas.PAGES).alias("pages"),
        F.array().cast(schemas.TABLES).alias("tables"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(classified(spark, sf_dir))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(extracted(spark, sf_dir))


# Faults planted in extracted fields, that no document text could produce.
TAMPER_SQL = {
    "seller.gstin": "CASE WHEN key % 8 = 1 THEN 'X' || {x} ELSE {x} END",
    "buyer.gstin": "CASE WHEN key % 8 = 2 THEN ' BAD ' ELSE {x} END",
    "seller.pan": "CASE WHEN key % 8 = 3 THEN 'ABC' ELSE {x} END",
    "buyer.pan": "CASE WHEN key % 8 = 4 THEN ' 12 ' ELSE {x} END",
    "totals.currency": "CASE WHEN key % 8 = 5 THEN 'XYZ' WHEN key % 8 = 6 THEN ' usd ' ELSE {x} END",
    "totals.tax_amount": "CASE WHEN key % 8 = 7 THEN '1.00' ELSE {x} END",
    "header.document_number": "CASE WHEN key % 6 = 1 THEN '  ' ELSE {x} END",
}
TAMPER_NO_ITEMS = "key % 10 = 3"


def tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted documents with planted faults, so that every rule has something to find."""
    df = extracted(spark, sf_dir)
    for path, sql in TAMPER_SQL.items():
        column, field = path.split(".")
        df = df.withColumn(column, F.col(column).withField(field, F.expr(sql.format(x=path))))
    empty = F.filter("line_items", lambda x: F.lit(False))
    return df.withColumn("line_items", F.when(F.expr(TAMPER_NO_ITEMS), empty).otherwise(F.col("line_items")))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(tampered(spark, sf_dir))


# --- vectors and requests ---------------------------------------------------------------
VECTOR_SQL = {
    "workspace_id": "concat('ws-', cast(label % 2 as string))",
    "document_id": "concat('label-', cast(label as string))",
    "document_type": "CASE WHEN label % 3 = 0 THEN 'GST Invoice' ELSE 'Receipt' END",
    "chunk_id": "concat('c-', cast(vec_id as string))",
    "chunk_index": "cast(vec_id as int)",
    "text_content": "CASE WHEN vec_id % 9 = 4 THEN NULL ELSE concat('  text of vector ', cast(vec_id as string), ' ') END",
}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks made from the embeddings table."""
    base = with_exprs(read(spark, sf_dir, "embeddings"), VECTOR_SQL)
    return base.select(
        "vec_id", *VECTOR_SQL, F.col("embedding").alias("vector"),
        F.lit(DIMENSIONS).alias("dimensions"), F.lit("given").alias("embedding_model"),
    )


QUESTION_SQL = {
    "query_id": "conv_id * 1000 + turn",
    "workspace_id": "concat(' ws-', cast(conv_id % 2 as string))",
    "first_doc": "concat('label-', cast((conv_id % 2) + 2 * (turn % 5) as string))",
    "second_doc": "concat('label-', cast((conv_id % 2) + 2 * ((turn + conv_id) % 5) as string))",
    "top_k": "cast(1 + conv_id % 10 as int)",
}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, each with a scope of one or two documents."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return with_exprs(turns, QUESTION_SQL).select(
        "query_id", "conv_id", "turn", "workspace_id",
        F.array("first_doc", F.concat("second_doc", F.lit(" "))).alias("selected_document_ids"),
        F.col("text").alias("query"), "top_k",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a given vector: a row of the embeddings table picked by key."""
    rows = read(spark, sf_dir, "embeddings")
    total = rows.agg((F.max("vec_id") + 1).alias("n"))
    asked = questions(spark, sf_dir).withColumn("n", total.scalar())
    picked = asked.withColumn("vec_id", F.expr("(conv_id * 31 + turn) % n"))
    return picked.join(rows.select("vec_id", F.col("embedding").alias("query_embedding")), "vec_id").select(
        "query_id", "workspace_id", "selected_document_ids", "query", "query_embedding", "top_k"
    )


SMALL = 8


def faulty_embedder():
    """Short vectors for texts of documents whose key is a multiple of 37 and 13 more."""
    import re

    def embed(texts: list[str]) -> list[list[float]]:
        keys = [re.search(r"Document ID: doc-(\d+)", t) for t in texts]
        return [[float(len(t))] * (3 if k and int(k[1]) % 37 == 13 else SMALL) for k, t in zip(keys, texts)]

    return embed


# Faults in requests, by key.
FAULTY_SQL = {
    "workspace_id": "CASE WHEN conv_id % 13 = 1 THEN ' ' ELSE workspace_id END",
    "query": (
        "CASE WHEN conv_id % 13 = 4 THEN '   ' WHEN conv_id % 13 = 5 THEN repeat(concat(query, ' '), 40) ELSE query END"
    ),
    "top_k": "cast(CASE WHEN conv_id % 13 = 6 THEN 0 WHEN conv_id % 13 = 7 THEN 51 ELSE top_k END as int)",
}


def faulty_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_exprs(questions(spark, sf_dir), FAULTY_SQL)
    ids = F.when(F.expr("conv_id % 13 = 2"), F.array().cast("array<string>")).when(
        F.expr("conv_id % 13 = 3"), F.array(F.lit("label-1"), F.lit(" "))
    ).otherwise(F.col("selected_document_ids"))
    return df.withColumn("selected_document_ids", ids)
