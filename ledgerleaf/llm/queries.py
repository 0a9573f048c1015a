"""Registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import balltree, bpe, collocations, contentsort, decontaminate, harmonic, licences, pagetext, quality, secrets, setjoin, spelling, toxicity

BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every text with its score; the values themselves stay out of the result."""
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(spark))
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows divisible by 50 are the stated query set; every row is searched."""
    vectors = table(spark, sf_dir, "embeddings")
    return balltree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_LEVEL))


def op9_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.groups(table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter is left out of every 31st word first, as the result's contract says."""
    return spelling.grouped(table(spark, sf_dir, "documents"), every=31)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_jaccard_join,
        op3_ball_tree_top_k,
        op4_toxicity,
        op5_quality,
        op6_licence_scan,
        op7_bpe_encoding,
        op8_harmonic_packing,
        op9_content_sort,
        op10_page_text,
        op11_phrases,
        op12_decontamination,
        op13_spelling_variants,
    )
}
