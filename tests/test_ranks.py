"""Exact percentiles against sorting."""

import math
import random

import pytest

from ledgerleaf.operators import ranks

FRACTIONS = [0.0, 0.05, 0.5, 0.95, 1.0]


def brute(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    out = {}
    for g, vs in groups.items():
        vs.sort(key=lambda v: (math.isnan(v), v))
        for p in FRACTIONS:
            out[g, p] = vs[max(math.ceil(p * len(vs)), 1) - 1]
    return out


@pytest.mark.parametrize("accuracy", [2_000, 40])
def test_percentiles_equal_sorting(spark, monkeypatch, accuracy):
    """A coarse sketch only takes more passes."""
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = random.Random(4)
    rows = [("hot", rng.lognormvariate(0, 6)) for _ in range(4_000)] + [("hot", 5.0)] * 3_000 + [("one", 1.5), ("none", None), (None, 2.0), (None, 3.0)]
    rows += [("same", 7.0)] * 500 + [("odd", v) for v in (-0.5, float("inf"), float("-inf"), float("nan"), 1e300, None)] + [("few", float(i)) for i in range(21)]
    got = {(r.stage, r.fraction): r.result for r in ranks.percentiles(spark.createDataFrame(rows, "stage string, ms double").repartition(5), "stage", "ms", FRACTIONS).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or (math.isnan(got[k]) and math.isnan(want[k])) for k in want)


def test_no_rows(spark):
    assert ranks.percentiles(spark.createDataFrame([], "stage string, ms double"), "stage", "ms", [0.5]).count() == 0
