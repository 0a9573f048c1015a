"""Versions of the vector table, and the stream that ends in it."""

import pytest
from helpers import GOLDEN
from pyspark.sql import functions as F

from ledgerleaf.operators import embed, snapshots, store
from ledgerleaf.streaming import arrivals


def rows(spark, ids, body, ws="w"):
    made = spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("i"))
    vectors = made.select(
        F.lit(ws).alias("workspace_id"), F.concat(F.lit("d"), F.col("i") % 5).alias("document_id"), F.lit("Receipt").alias("document_type"),
        F.concat(F.lit("c"), "i").alias("chunk_id"), F.col("i").cast("int").alias("chunk_index"), F.lit(body).alias("text_content"),
        F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit(1).alias("dimensions"), F.lit("m").alias("embedding_model"),
    )
    return store.records(vectors, 4)


def content(spark, path, version=None):
    return sorted((r.chunk_id, r.text_content) for r in store.table(spark, path, version).collect())


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.upsert(spark, rows(spark, range(10), "one"), path) == 1
    pinned = store.table(spark, path)
    before = content(spark, path)
    assert store.upsert(spark, rows(spark, [1, 2, 11], "two"), path) == 2
    assert sorted((r.chunk_id, r.text_content) for r in pinned.collect()) == before == content(spark, path, 1)
    assert content(spark, path) == sorted([(f"c{i}", "two" if i in (1, 2, 11) else "one") for i in range(12) if i != 10])


@pytest.mark.parametrize("step", ["data", "manifest", "switch"])
def test_a_writer_that_stops_midway_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    store.upsert(spark, rows(spark, range(10), "one"), path)
    before = content(spark, path)

    class Stopped(Exception):
        pass

    def stop(*args, **kwargs):
        raise Stopped

    with monkeypatch.context() as m:
        if step == "switch":
            m.setattr(snapshots._Files, "put", stop)
        else:
            plain, calls = type(spark.range(0).write).parquet, []

            def parquet(self, target, *args, **kwargs):
                plain(self, target, *args, **kwargs)
                calls.append(target)
                if ("/data/" if step == "data" else "/manifests/") in target:
                    raise Stopped

            m.setattr(type(spark.range(0).write), "parquet", parquet)
        with pytest.raises(Stopped):
            store.upsert(spark, rows(spark, range(5), "two"), path)
    assert content(spark, path) == before
    store.upsert(spark, rows(spark, range(5), "two"), path)
    assert content(spark, path) == sorted((f"c{i}", "two" if i < 5 else "one") for i in range(10))


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """The slower writer finds its version taken, and merges into the one that was faster."""
    path = str(tmp_path / "t")
    store.upsert(spark, rows(spark, range(4), "one"), path)
    put, done = snapshots._Files.put, []

    def late(self, name, text):
        if not done:
            done.append(name)
            store.upsert(spark, rows(spark, [1, 20], "fast"), path)
        put(self, name, text)

    monkeypatch.setattr(snapshots._Files, "put", late)
    assert store.upsert(spark, rows(spark, [2, 21], "slow"), path) == 3
    assert content(spark, path) == sorted([("c0", "one"), ("c1", "fast"), ("c2", "slow"), ("c3", "one"), ("c20", "fast"), ("c21", "slow")])


def test_untouched_partitions_stay_where_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    store.upsert(spark, rows(spark, range(40), "one", "001"), path)
    store.upsert(spark, rows(spark, [0], "two", "001"), path)
    at = snapshots.version(spark, path)
    by_commit = snapshots._manifest(spark, path, at).groupBy("commit").count().collect()
    assert sorted(r["count"] for r in by_commit)[0] == 1 and len(by_commit) == 2
    assert {r.workspace_id for r in store.table(spark, path).collect()} == {"001"}
    assert store.table(spark, path).count() == 40


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path = str(tmp_path / "t")
    for body in ("one", "two", "three", "four"):
        store.upsert(spark, rows(spark, range(10), body), path)
    assert snapshots.vacuum(spark, path, keep=2) == []  # too young
    dead = snapshots.vacuum(spark, path, keep=2, older_than=0)
    assert sum(n.startswith("data/") for n in dead) == 2
    assert {t for _, t in content(spark, path)} == {"four"} and {t for _, t in content(spark, path, 3)} == {"three"}
    with pytest.raises(Exception):
        content(spark, path, 1)


def test_empty_batch_and_missing_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        store.table(spark, path)
    assert store.upsert(spark, rows(spark, range(3), "one").limit(0), path, ledger=("s", 0)) == 1
    assert store.table(spark, path).count() == 0
    store.upsert(spark, rows(spark, range(3), "one"), path, ledger=("s", 1))
    assert store.upsert(spark, rows(spark, range(9), "again"), path, ledger=("s", 1)) == 2
    assert store.upsert(spark, rows(spark, range(1), "other"), path, ledger=("t", 0)) == 3
    assert content(spark, path) == [("c0", "other"), ("c1", "one"), ("c2", "one")]


class Killed(Exception):
    pass


@pytest.mark.parametrize("moment", ["before", "after"])
def test_stream_killed_around_the_commit_ends_in_the_same_table(spark, tmp_path, monkeypatch, moment):
    """``after``: vectors are committed, the stream's own commit is not."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(6):
        (inbox / f"{i}.txt").write_text(f"RECEIPT\nnumber {i}\n")
    (inbox / "bad.exe").write_text("x")
    (inbox / "invoice.txt").write_text(GOLDEN)  # no line items, so it stops at validation

    def run(path, checkpoint, **options):
        arrivals.ingest_into(
            spark, str(inbox), checkpoint, path, embed.hashing_embedder(4), workspace_id="ws", max_files=3, dimensions=4, **options
        ).awaitTermination()

    def stored(path):
        return sorted((r.record_id, r.text_content, [round(x, 5) for x in r.vector]) for r in store.table(spark, path).collect())

    run(str(tmp_path / "whole"), str(tmp_path / "state-whole"))
    want = stored(str(tmp_path / "whole"))
    assert len(want) == 6
    path, state, seen = str(tmp_path / "killed"), str(tmp_path / "state-killed"), []
    put = snapshots._Files.put

    def die(self, name, text):
        seen.append(name)
        if moment == "before" and len(seen) == 2:
            raise Killed
        put(self, name, text)

    def after(done, batch_id):
        if moment == "after" and batch_id == 1 and len(seen) == 2:
            raise Killed

    with monkeypatch.context() as m:
        m.setattr(snapshots._Files, "put", die)
        with pytest.raises(Exception, match="Killed"):
            run(path, state, on_run=after)
    versions = len(snapshots.numbers(spark, path))
    assert versions == (1 if moment == "before" else 2)
    run(path, state)
    assert stored(path) == want
    run(path, state)
    assert stored(path) == want
    assert len(snapshots.numbers(spark, path)) == 3  # one for each batch


def parts(spark, path):
    at = snapshots.version(spark, path)
    return {(r.bucket, r.commit) for r in snapshots._manifest(spark, path, at).collect()}


def test_new_rows_leave_stored_ones_where_they_are(spark, tmp_path, monkeypatch):
    """A batch is written beside the rows of a partition; only commits with a key of the batch are written anew."""
    path = str(tmp_path / "t")
    store.upsert(spark, rows(spark, range(0, 20), "one"), path)
    first = parts(spark, path)
    store.upsert(spark, rows(spark, range(20, 40), "two"), path)
    second = parts(spark, path)
    assert first < second and len(second) == 2 * len(first)
    store.upsert(spark, rows(spark, [25], "three"), path)
    assert len(second - parts(spark, path)) == 1 and first < parts(spark, path)
    assert content(spark, path) == sorted((f"c{i}", "three" if i == 25 else "one" if i < 20 else "two") for i in range(40))
    replacing = rows(spark, [50], "four")  # of document d0
    store.upsert(spark, replacing, path, replace_document=True)
    assert content(spark, path) == sorted([("c50", "four"), *((f"c{i}", "three" if i == 25 else "one" if i < 20 else "two") for i in range(40) if i % 5)])
    monkeypatch.setattr(snapshots, "PARTS", 1)
    store.upsert(spark, rows(spark, range(60, 80), "five"), path)
    assert len(parts(spark, path)) == len(first)
    assert len(content(spark, path)) == 1 + 32 + 20
