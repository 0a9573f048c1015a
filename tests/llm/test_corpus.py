import re
from zlib import crc32

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, rows_of
from ledgerleaf.llm import oracles, queries, quality, secrets
from test_setjoin import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, SF_DIR), db.sql(oracles.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(list(rel.columns), rel.fetchall())


def test_all_are_registered():
    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


def test_stages_follow_a_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").persist()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, SF_DIR).persist()
    score = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s >= quality.KEEP}
    once = corpus_pipeline.exact_dedup(spark, kept, SF_DIR).persist()
    first = {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(first.values())
    one = corpus_pipeline.near_dedup(spark, once, SF_DIR).persist()
    roots = brute([(r.doc_id, r.text) for r in once.collect()], 5, 80)
    assert {r.doc_id for r in one.collect()} == {root for _, root in roots.values()}
    clean = corpus_pipeline.mask_secrets(spark, one, SF_DIR).persist()
    assert clean.count() == one.count()
    assert clean.filter(r"text rlike '(?i)token = \"[0-9a-f]{40}'").count() == 0
    assert kept.columns == once.columns == one.columns == clean.columns == docs.columns
    packed = corpus_pipeline.pack(spark, clean, SF_DIR).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
    assert corpus_pipeline.run(spark, SF_DIR).count() >= len(packed)


def test_stages_of_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", None, 5, "x"), (2, text, None, "s", None, "x"), (3, text + " more", "en", "s", 5, None), (None, None, None, None, None, None), (4, "", "en", "s", 0, "x"), (4, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame, most in ((docs, 3), (docs.limit(0), 0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        assert out.count() <= most
    assert crc32(b"x")  # identifiers are held out by this sum
    assert secrets.SECRET == 0.5
