import re
from collections import defaultdict
from hashlib import sha256

import pytest

from ledgerleaf.llm import contentsort


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


ROWS = [
    (1, "a b", 1), (2, "a  b", 2), (3, None, 3), (None, "", 4), (5, "x" * 100_000, 5), (6, "x" * 100_000 + "y", 6), (2, "a\tb", 7), (2, "a\tb", 7),
    (None, "zz", 8), (7, " a b", 9), (8, "a b", 10), *((100 + i, "hot text", i) for i in range(3000)),
]


def test_groups(spark, many_ranges):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, part int").repartition(5)
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = contentsort.groups(df).collect()
    assert len(got) == len(ROWS)
    by_hash = {sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_that_stay_are_whole(spark, many_ranges):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, part int").repartition(5)
    out = contentsort.deduplicated(df)
    assert out.columns == df.columns
    rows = {(r.doc_id, r.text, r.part) for r in out.collect()}
    assert rows <= set(ROWS)
    assert len(rows) == 8
    assert (3, None, 3) in rows
    assert contentsort.groups(df.limit(0)).count() == 0
