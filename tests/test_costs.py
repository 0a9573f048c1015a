"""What a run writes, and how often it makes the same columns."""

from helpers import GOLDEN, parsed
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import session
from ledgerleaf.operators import embed
from ledgerleaf.operators.classify import classify
from ledgerleaf.operators.extract import extract
from ledgerleaf.operators.validate import validate
from ledgerleaf.plans import ingest


def test_reviewed_documents_are_written_without_their_pages(spark, monkeypatch):
    real, written = session.saved, {}

    def saved(df, label):
        written[label] = df.columns
        return real(df, label)

    monkeypatch.setattr(session, "saved", saved)
    docs = parsed(spark, ("a", "RECEIPT\nDATE: 2026-08-20\nTOTAL: 5.00"), ("b", GOLDEN, [["x", "1", "2", "102000.00"]], ["Item"]), ("c", GOLDEN))
    run = ingest.ingest(docs, embed.hashing_embedder(4), dimensions=4)
    assert set(written["reviewed"]) == set(ingest.KEPT)
    assert {(r.document_id, r.success) for r in run.results.collect()} >= {("a", True), ("c", False)}
    assert run.issues.filter("document_id = 'c'").count() > 0


def test_columns_of_the_stages_are_built_once(spark, monkeypatch):
    docs = parsed(spark, ("a", "RECEIPT\nTOTAL: 5.00"))
    stages = lambda: validate(extract(classify(docs)))
    want = stages().collect()
    made, real = [], F.lit
    monkeypatch.setattr(F, "lit", lambda *a: made.append(a) or real(*a))
    again = stages()
    assert len(made) < 20  # more than a thousand before
    assert again.collect() == want


def test_folders_are_listed_by_a_bounded_number_of_tasks(spark):
    assert isinstance(spark, SparkSession)
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 4 * max(8, spark.sparkContext.defaultParallelism)
