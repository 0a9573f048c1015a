"""Embedding, vector table, retrieval, answers."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import approx, ask, embed, retrieve, store

COLUMNS = (
    "workspace_id string, document_id string, document_type string, chunk_id string, chunk_index int, "
    "text_content string, vector array<float>, dimensions int, embedding_model string"
)


def rows(n=60, d=4, seed=1):
    rng = random.Random(seed)
    return [
        (f"w{i % 2}", f"d{i % 6}", "Receipt", f"c{i}", i, f"text {i}", [rng.choice([0.0, 1.0, 2.0]) for _ in range(d)], d, "m")
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def vectors(spark):
    return store.records(spark.createDataFrame(rows(), COLUMNS)).persist()


def asked(spark, *requests):
    return spark.createDataFrame(
        list(requests),
        "query_id int, workspace_id string, selected_document_ids array<string>, query_embedding array<float>, top_k int",
    )


def brute(requests, metric=lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))):
    out = set()
    for q, ws, docs, v, k in requests:
        scope = {x.strip() for x in docs}
        found = sorted(
            (metric(r[6], v), f"{r[0]}:{r[1]}:{r[3]}") for r in rows() if r[0] == ws.strip() and r[1] in scope
        )
        out |= {(q, i + 1, rec) for i, (_, rec) in enumerate(found[:k])}
    return out


REQUESTS = [
    (1, "w0", ["d0", "d2 ", "d0"], [1.0, 0.0, 2.0, 1.0], 7),
    (2, " w1", ["d1"], [0.0, 0.0, 0.0, 0.0], 50),
    (3, "w1", ["d0"], [0.0, 0.0, 0.0, 0.0], 5),
]


@pytest.mark.parametrize("plan", ["block", "join"])
def test_top_k_with_many_ties(spark, vectors, plan):
    hits = retrieve.top_k(vectors, asked(spark, *REQUESTS), plan=plan)
    assert {(r.query_id, r["rank"], r.record_id) for r in hits.collect()} == brute(REQUESTS)


def test_auto_leaves_the_block_plan_when_requests_are_many(spark, vectors, monkeypatch):
    monkeypatch.setattr(retrieve, "MAX_BLOCK_REQUESTS", 1)
    hits = retrieve.top_k(vectors, asked(spark, *REQUESTS))
    assert {(r.query_id, r["rank"], r.record_id) for r in hits.collect()} == brute(REQUESTS)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        retrieve.top_k(vectors, asked(spark, *REQUESTS), plan="block")


def test_approximate_search_of_all_cells_is_exact(spark, vectors):
    requests = asked(spark, *REQUESTS)
    centres = approx.fit_cells(vectors, 4, cells=5)
    found = approx.approx_top_k(approx.with_cell(vectors, centres), requests, centres, probes=5)
    shares = approx.recall(found, retrieve.top_k(vectors, requests)).collect()
    assert {r.query_id: r.recall for r in shares} == {1: 1.0, 2: 1.0}


def test_approximate_search_finds_most(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["h4_approximate_top_k"](spark, "/root/testdata/sf0.01").agg(F.sum("found") / F.sum("hits")).first()
    assert rows[0] >= 0.9


def test_same_record_id_in_two_workspaces_stays_apart(spark):
    rows = [("a", "b:c", "d", "one"), ("a:b", "c", "d", "two")]
    df = spark.createDataFrame([(w, d, c, 0, "t", [1.0, 2.0], t) for w, d, c, t in rows], "workspace_id string, document_id string, chunk_id string, chunk_index int, document_type string, vector array<float>, text_content string")
    stored = store.records(df.withColumns({"dimensions": F.lit(2), "embedding_model": F.lit("m")}))
    assert stored.select("record_id").distinct().count() == 1
    requests = spark.createDataFrame([(1, "a", ["b:c"], [1.0, 2.0], 5), (2, "a:b", ["c"], [1.0, 2.0], 5), (3, "a", ["b:c"], [1.0], None)], "query_id int, workspace_id string, selected_document_ids array<string>, query_embedding array<float>, top_k int")
    for plan in ("block", "join"):
        got = {(r.query_id, r.text_content) for r in retrieve.top_k(stored, requests, plan=plan).collect()}
        assert got == {(1, "one"), (2, "two")}


def test_distances_that_are_no_number_come_last_in_both_plans(spark):
    df = spark.createDataFrame([("w", "d", str(i), i, "t", v, "x") for i, v in enumerate(([1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.5, 1.0]))], "workspace_id string, document_id string, chunk_id string, chunk_index int, document_type string, vector array<float>, text_content string")
    stored = store.records(df.withColumns({"dimensions": F.lit(2), "embedding_model": F.lit("m")}))
    requests = spark.createDataFrame([(1, "w", ["d"], [1.0, 0.0], 3)], "query_id int, workspace_id string, selected_document_ids array<string>, query_embedding array<float>, top_k int")
    plans = [[(r["rank"], r.chunk_id) for r in retrieve.top_k(stored, requests, plan=p, metric="cosine").orderBy("rank").collect()] for p in ("block", "join")]
    assert plans[0] == plans[1] == [(1, "0"), (2, "3"), (3, "1")]


def test_embedding_batches_order_and_failures(spark):
    class Fake:
        def __call__(self, texts):
            assert len(texts) <= 100
            if any("fail" in t for t in texts):
                raise RuntimeError("secret detail")
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(250)], "i int, text_content string").coalesce(1)
    got = embed.embed(df, lambda: Fake(), dimensions=2).collect()
    assert all(r.vector == [float(r.i), 1.0] and r.embed_error is None for r in got) and len(got) == 250
    bad = embed.embed(spark.createDataFrame([(1, "fail")], "i int, text_content string"), lambda: Fake(), dimensions=2)
    assert bad.first().embed_error == "provider_error: RuntimeError"
    mixed = spark.createDataFrame([(i, "fail" if i == 7 else "ok") for i in range(30)], "i int, text_content string").coalesce(1)
    assert [r.i for r in embed.embed(mixed, lambda: Fake(), dimensions=2).filter("embed_error is not null").collect()] == [7]
    wrong = embed.embed(df.limit(1), lambda: Fake(), dimensions=3).first()
    assert wrong.embed_error == "dimension_mismatch: expected 3, got 2"


def table(spark, path):
    return {(r.record_id, r.text_content) for r in store.table(spark, path).collect()}


def test_upsert_is_idempotent_and_replaces(spark, vectors, tmp_path):
    path = str(tmp_path / "table")
    store.upsert(spark, vectors, path)
    once = table(spark, path)
    store.upsert(spark, vectors, path)
    assert table(spark, path) == once and len(once) == 60
    change = vectors.filter("document_id = 'd0' and chunk_index < 12").withColumn("text_content", F.lit("new"))
    store.upsert(spark, change, path)
    assert len(table(spark, path)) == 60 and sum(t == "new" for _, t in table(spark, path)) == 2
    store.upsert(spark, change, path, replace_document=True)
    assert len(table(spark, path)) == 52
    hits = retrieve.top_k(store.table(spark, path), asked(spark, *REQUESTS[1:2]), buckets=store.DEFAULT_BUCKETS)
    assert {(r.query_id, r["rank"], r.record_id) for r in hits.collect()} == brute(REQUESTS[1:2])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace_id" in plan or "workspace_id#" in plan.split("PartitionFilters:")[1][:200]


def test_payload_errors(spark):
    def doc(name, *chunks, kind="Receipt", ws="w"):
        return [(ws, name, kind, c, i, "t", v, 2, "m") for i, (c, v) in enumerate(chunks)]

    ok = [1.0, 2.0]
    data = (
        doc("good", ("a", ok), ("b", ok))
        + doc("dup", ("a", ok), (" a", ok), ("", ok))
        + doc("blank", ("a", ok), (" ", ok), ("a", ok))
        + doc("empty", ("a", []), ("b", [1.0]))
        + doc("short", ("a", ok), ("b", [1.0]))
        + doc("kind", ("a", ok), kind=" ")
        + doc(" ", ("a", ok))
    )
    got = {r.document_id: (r.reason, r.position) for r in store.payload_errors(spark.createDataFrame(data, COLUMNS)).collect()}
    assert got == {
        "dup": ("duplicate_chunk_id", 1), "blank": ("missing_chunk_id", 1), "empty": ("empty_vector", 0),
        "short": ("dimension_mismatch", 1), "kind": ("missing_document_type", None), " ": ("missing_document_id", None),
    }


def test_answers_cover_every_question(spark, vectors):
    questions = spark.createDataFrame(
        [
            (1, "w0", ["d0"], "text 0?", 3), (2, "w0", ["d1"], "other workspace", 3), (3, " ", ["d0"], "x", 3),
            (4, "w0", [], "x", 3), (5, "w0", ["d0"], "y" * 1001, 3), (6, "w0", ["d0"], "x", 0),
        ],
        "query_id int, workspace_id string, selected_document_ids array<string>, query string, top_k int",
    )
    calls = spark.sparkContext.accumulator(0)

    def make():
        inner = embed.hashing_embedder(4)()

        def run(texts):
            calls.add(len(texts))
            return inner(texts)

        return run

    got = {r.query_id: r for r in ask.answer(questions, vectors, make, ask.echo_generator, dimensions=4).collect()}
    assert got[1].total_sources_retrieved == 3 and got[1].answer == got[1].source_chunks[0].snippet
    assert got[2].answer.startswith("The available selected documents") and got[2].total_sources_retrieved == 0
    assert {q: got[q].error for q in (3, 4, 5, 6)} == {
        3: "missing_workspace_id", 4: "missing_scope", 5: "query_too_long", 6: "top_k_too_small",
    }
    assert calls.value == 2  # each good question is embedded once


def test_summary_of_a_hot_document_is_counted_without_an_array(spark):
    rows = spark.range(5_000).selectExpr("'w' AS workspace_id", "'hot' AS document_id", "concat('w:hot:', id) AS record_id")
    counts = store.upsert_summary(rows)
    assert [tuple(r) for r in counts.collect()] == [("w", "hot", 5_000)]
    assert "collect_list" not in counts._jdf.queryExecution().toString()
    ids = store.upserted_ids(rows)
    assert ids.columns == ["workspace_id", "document_id", "record_id"] and ids.count() == 5_000
