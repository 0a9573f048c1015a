import math
import random

import pytest

from ledgerleaf.llm import balltree


def brute(rows, asked, k, scale=256.0):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(scale * x) for x in v]
    rows = [(i, whole(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for q in asked:
        vector = min((v for i, v in rows if i == q), default=None)
        if vector is not None:
            hits = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in rows if i != q and len(v) == len(vector))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(hits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 8192])
def test_hits_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "LEAF", 8)
    monkeypatch.setattr(balltree, "BLOCK", 7)
    rng = random.Random(shard)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5, -0.25, 0.0, 1.0, 0.125, -1.0]) for i in range(400, 600)]
    rows += [(600, None), (601, [None] * 6), (602, [1.0, float("nan"), 0.0, 0.0]), (650, [float("inf")] * 6), (None, [1.0] * 6), (700, []), (701, []), (750, [1.0, 2.0]), (751, [3.0, -4.0]), (3, rows[3][1])]
    rows += [(800, [3e3] * 6), (801, [-3e3] * 6)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(4)
    asked = [i for i, _ in rows if i is not None and i % 50 == 0]
    got = sorted(tuple(r) for r in balltree.top_k(df, df.filter("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, sorted(set(asked)), 5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert balltree.top_k(df, df, 5).count() == 0


def test_nodes_are_left_out(monkeypatch):
    """In grouped data most leaves are never scored."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = (np.repeat(rng.normal(0, 1000, (40, 16)), 100, axis=0) + rng.normal(0, 5, (4000, 16))).astype(np.int64)
    read = []
    whole = balltree.Best.read
    monkeypatch.setattr(balltree.Best, "read", lambda self, tree, a, b, ask: (read.append((b - a) * len(ask)), whole(self, tree, a, b, ask)))
    balltree.Best(np.arange(10_000, 10_020), rows[::200], 5).search([balltree.Tree(np.arange(4000), rows)])
    assert sum(read) < 0.3 * 20 * 4000
