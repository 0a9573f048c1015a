import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerleaf.llm import spelling


def edits(a, b):
    """Whether one insertion, deletion or replacement leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, every):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if x != w and edits(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


BASE = ["necessary", "recommend", "Élémentaire", "straßenbahn", "accommodate", "aaaaaaaaa", "bananarama"]
DOCS = [
    (1, "necessary " * 40 + "necesary necesary neccessary neccessary nezessary, nezessary" + " necessar" * 4 + " necessa" * 2),
    (2, "Recommend recommend; recomend recomend reccomend RECCOMEND " + "recommend " * 30), (2, "élémentaire Élémentaire " * 12 + "lémentaire lémentaire"), (None, "straßenbahn " * 9 + "strassenbahn strassenbahn"),
    (None, None), (3, ""), (4, "aaaaaaaa aaaaaaaaa aaaaaaaaaa " * 3), (5, "x" * 20_000 + " " + "x" * 20_000 + " " + "x" * 20_001 + " " + "x" * 20_001), (6, "word×with÷signs word×with÷signs œuvres日本語necessary"),
    (7, " ".join(w[:k] + "q" + w[k + 1 :] for w in BASE for k in range(len(w)) for _ in range(2))),
    (8, "abcdefgh bacdefgh acbdefgh " * 2),
]
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("every", [None, 3, 31])
@pytest.mark.parametrize("tile", [8192, 4])
def test_variants_equal_brute_force(spark, monkeypatch, every, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.grouped(docs, every)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(DOCS, every)
    assert spelling.grouped(docs.limit(0)).count() == 0


def test_chain_of_forms(spark):
    rows = [("abcdefgh", 1), ("abcdefghi", 10), ("abcdefghij", 100), ("abcdefghijk", 1000), ("abcdefghijx", 1000), ("zzzzzzzz", 10**17), ("zzzzzzzzz", 10**18)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert [got[w].root for w, _ in rows] == ["abcdefghijk"] * 4 + ["abcdefghijx", "zzzzzzzzz", "zzzzzzzzz"]
    assert got["abcdefghij"].n_near == 3
    assert got["zzzzzzzz"].form_n == 10**18


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=25))
def test_products_find_each_pair_once(some):
    """All choices together give each pair once, also where letters are spread over the groups at will."""
    words = sorted((w.encode("latin-1") for w in some), key=lambda w: (len(w), w))
    group = np.arange(len(spelling.LETTERS)) % spelling.GROUPS
    found = Counter()
    counts = spelling.count_matrix(words)
    for k, choice in enumerate(spelling.CHOICES):
        own = counts[:, np.isin(group, choice)]
        block = np.unique(own, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((np.arange(len(words)), [len(w) for w in words], block))
        sorted_words = [words[i] for i in order.tolist()]
        zero = np.zeros(len(words), np.int64)
        a, b = spelling.near_pairs(sorted_words, block[order], zero, zero.astype(bool), zero + k, group)
        found.update(frozenset((sorted_words[i], sorted_words[j])) for i, j in zip(a.tolist(), b.tolist()))
    want = {frozenset(p) for p in combinations(words, 2) if edits(*p)}
    assert found == Counter(want)
