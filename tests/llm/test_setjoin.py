import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerleaf.llm import setjoin
from ledgerleaf.llm.components import components


def brute(rows, k, percent):
    """Set size and smallest linked identifier of every row."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i_, j_ = find(i), find(j)
                up[max(i_, j_)] = min(i_, j_)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n, hot=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[rng.randrange(3) :] + [word()] * rng.randrange(3)
            texts.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.choice((0, 1, 3, 4, 5, 7, 9, 12, 20, 40, 90, 200)))]
            texts.append(" ".join(w + passage if kind > 0.85 else w))
    base = [word() for _ in range(120)]
    for _ in range(hot):
        w = list(base)
        w[rng.randrange(120)] = word()
        texts.append(" ".join(w))
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "percent", "hot", "tokens"), [(4, 85, 60, 300), (5, 80, 60, 5_000_000)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, hot, tokens):
    monkeypatch.setattr(setjoin, "TOKENS", tokens)
    monkeypatch.setattr(setjoin, "BLOCK", 5)
    rows = corpus(k, 260, hot)
    rows += [(100_000, "A B\tc d e f g h"), (100_001, "a b c d  E f g h"), (100_002, "Ä B c d e f g h"), (100_003, None), (100_004, " \n")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, vertex int, n string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.linked(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, ""), (4, None), (5, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in setjoin.linked(df, 4, 85).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (None, 0, None), (3, 0, 3), (4, 0, 4), (5, 1, 5)], key=repr)
    assert setjoin.linked(df.limit(0)).count() == 0


def test_one_of_each_keeps_whole_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 5), (2, text + " more", 6), (3, "other words stand here now", 7), (None, text, 8), (4, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    out = setjoin.one_of_each(df)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {rows[0], *rows[2:]}


def test_linked_sets_share_a_probing_key():
    """The pigeonhole: any two linked sets have a key in common, of which one side probes."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        plan = setjoin.Plan(percent)
        for n in [*range(6, 60), 100, 333]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            lose = rng.integers(0, n * (100 - percent) // 100 + 1)
            more = rng.integers(0, max(1, (100 * (n - lose) - percent * n) // percent + 1))
            b = np.unique(np.concatenate([a[lose:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same < percent * (len(a) + len(b) - same) or same == len(a) == len(b):
                continue
            key, who, probe, _ = plan.entries([a, b])
            sides = defaultdict(lambda: [0, 0])
            for k, w, p in zip(key.tolist(), who.tolist(), probe.tolist()):
                sides[k][w] |= 1 + p
            assert any(x and y and max(x, y) > 1 for x, y in sides.values()), (percent, n)


def test_wider_maps_fold_to_narrower_ones():
    s = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    wide = setjoin.parity(s, setjoin.width(len(s)))
    assert setjoin.width(len(s)) >= len(s) and setjoin.width(3) == setjoin.BITS
    assert setjoin.narrowed([wide, setjoin.parity(s)])[0].tobytes() == setjoin.parity(s)
    t = s[7:3000]
    assert setjoin.pairwise_apart([wide, wide], [setjoin.parity(t, setjoin.width(len(t))), wide]).tolist() == [
        int(np.bitwise_count(np.frombuffer(setjoin.parity(s, 4096), np.uint8) ^ np.frombuffer(setjoin.parity(t, 4096), np.uint8)).sum()), 0
    ]


def test_long_texts_of_one_key_make_no_rows_unless_they_are_near(spark):
    """Narrow maps of long texts are all alike: every pair of the key became a row, with the square of its texts."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in rng.integers(300, 6000, 60)]
    sets += [np.concatenate([x[len(x) // 20 :], rng.integers(0, 1 << 63, 5).astype(np.uint64)]) for x in sets[:20]]
    rows = [(9, i, i, len(x), bytearray(setjoin.parity(x, setjoin.width(len(x))))) for i, x in enumerate(sets)]
    entries = spark.createDataFrame(rows, "key long, vertex long, root long, n long, map binary")
    got = sorted(tuple(r) for r in setjoin._close_pairs(entries, 80).distinct().collect())
    assert got == [(i, i + 60) for i in range(20)]


def test_texts_with_a_common_passage_make_few_pairs(spark, monkeypatch):
    """Long texts that share passages only: whole sets are made for pairs that maps let be linked."""
    tables, settled = {}, setjoin.settled

    def seen(df, label, *rest):
        out = settled(df, label, *rest)
        tables[label] = max(tables.get(label, 0), out.count())
        return out

    monkeypatch.setattr(setjoin, "settled", seen)
    monkeypatch.setattr(setjoin, "TOKENS", 20_000)
    rng = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(500)) for k in range(3)]
    texts = []
    for _ in range(60):
        own = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(1000, 1200))]
        texts.append(" ".join([passages[0], *own[:400], rng.choice(passages[1:]), *own[400:]]))
    texts += [t + " one more" for t in texts[:5]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.linked(df, 5, 80).collect()}
    assert got == brute(rows, 5, 80)
    assert tables["candidates"] > 0 and tables.get("sets", 0) <= 10 and tables.get("close", 0) <= 5


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, 500 + i) for i in range(1, 200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
