"""Exact search by tiles: bounded groups, the same rows as scoring every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.vectors import METRICS, block_distance
from ledgerleaf.operators import retrieve, store

COLUMNS = (
    "workspace_id string, document_id string, document_type string, chunk_id string, chunk_index int, "
    "text_content string, vector array<float>, dimensions int, embedding_model string"
)
ASKED = "query_id int, workspace_id string, selected_document_ids array<string>, query_embedding array<float>, top_k int"


def every_pair(rows, record, asked, keep, metric):
    out = []
    for i, (query, k) in enumerate(zip(asked, keep)):
        dist = block_distance(query, rows, metric)
        order = sorted(range(len(rows)), key=lambda j: (np.isnan(dist[j]), np.nan_to_num(dist[j], nan=0.0, posinf=np.inf), record[j]))
        out += [(i, record[j], repr(dist[j])) for j in order[:k]]
    return sorted(out)


@pytest.mark.parametrize("metric", METRICS)
def test_bounds_lose_no_row(metric, monkeypatch):
    monkeypatch.setattr(retrieve, "TILE_FLOATS", 700)
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, (90, 3)).astype("float64")
    rows[:20] += rng.normal(size=(20, 3)) * 1e-9
    rows[20:30] = rng.normal(size=(10, 3)) * 1e160
    rows[30, 1], rows[31, 0], rows[32] = np.nan, np.inf, 1e-200
    asked = np.concatenate([rows[::9], rng.normal(size=(20, 3)), np.full((1, 3), np.nan), np.zeros((1, 3))])
    record = np.array([f"r{i % 80:02d}" for i in rng.permutation(90)], dtype=object)
    keep = rng.integers(1, 12, len(asked))
    with np.errstate(all="ignore"):
        who, row, dist = retrieve.nearest_in_tile(rows, record, asked, keep, metric)
        assert sorted(zip(who.tolist(), record[row], map(repr, dist))) == every_pair(rows, record, asked, keep, metric)


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_many_tiles_give_the_rows_of_the_block_plan(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    made = [
        (f"w{i % 2}", "hot" if i % 4 < 2 else f"d{i % 24}", "t", f"c{i}", i, "x", rng.integers(0, 3, 3 if i % 10 else 2).astype(float).tolist(), 3, "m")
        for i in range(240)
    ]
    stored = store.records(spark.createDataFrame(made, COLUMNS))
    requests = spark.createDataFrame(
        [(q, f"w{q % 2}", ["hot", f"d{q % 24}", f"d{(q + 4) % 24}", "none"], rng.integers(0, 3, 3).astype(float).tolist(), 1 + q % 9) for q in range(60)]
        + [(61, "w0", ["hot"], [1.0, 1.0], 50), (62, "w1", ["none"], [1.0, 1.0, 1.0], 5)],
        ASKED,
    )

    def ranked(plan):
        hits = retrieve.top_k(stored, requests, metric=metric, plan=plan)
        return sorted((r.query_id, r["rank"], r.record_id, repr(r.distance)) for r in hits.collect())

    want = ranked("block")
    for size in (16, 4096):
        monkeypatch.setattr(retrieve, "TILE_ROWS", size)
        assert ranked("join") == want


def test_pairs_of_a_large_document_are_no_rows(spark):
    rng = np.random.default_rng(7)
    made = [("w", "d", "t", f"c{i}", i, "x", rng.normal(size=2).tolist(), 2, "m") for i in range(400)]
    stored = store.records(spark.createDataFrame(made, COLUMNS))
    requests = spark.createDataFrame([(q, "w", ["d"], rng.normal(size=2).tolist(), 2) for q in range(300)], ASKED)
    hits = retrieve.top_k(stored, requests, plan="join")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and hits.count() == 600
    found = retrieve.scored_in_tiles(stored, retrieve._cleaned(requests), "l2sq")
    assert found.agg(F.count("*")).first()[0] == 600  # not 120,000
