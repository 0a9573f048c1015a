import random
from zlib import crc32

import pytest

from ledgerleaf.llm import quality, subword, toxicity
from ledgerleaf.llm.automaton import Automaton, edits_of

SF_DIR = "/root/testdata/sf0.1"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["idiot", "moron", "scum", "worthless", "pathetic", "disgusting", "abab", "ababa", "straße"]
    words = set()
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                what = rng.randrange(3)
                if what == 0:
                    w.insert(k, rng.choice("abdiorsßt"))
                elif k < len(w):
                    w[k : k + 1] = [] if what == 1 else [rng.choice("abdiorsßt")]
            words.add("".join(w))
    automaton = Automaton(terms)
    for w in words | {""}:
        near = min(((edits(w, t), t) for t in sorted(terms) if edits(w, t) <= edits_of(t)), default=None)
        got = automaton.match(w)
        assert (got and (got[1], automaton.terms[got[0]])) == near


def test_quotation_counts_less_than_abuse():
    spans = lambda t: [m.span() for m in toxicity.WORD.finditer(t)]
    shares = []
    for t, k in (("he wrote the word \"idiot\" in it", 4), ("what an idiot sat here", 2), ("you are such an idiot now", 4)):
        shares.append(toxicity.context(t, spans(t), k))
    assert shares[0] < shares[1] < shares[2]


def test_misspelled_terms_are_hits():
    reader = toxicity.Reader(dict.fromkeys(toxicity.INSULTS, 2.0))
    assert [(t, e) for *_, t, e, _ in reader.hits("you IDIOTT and wortless patheticc thing")] == [("idiot", 1), ("worthless", 1), ("pathetic", 1)]


@pytest.mark.parametrize(
    ("run", "label", "parts", "part", "least"), [(quality.scored, "quality", 5, 0, 0.97), (toxicity.scored, "toxic", 3, 1, 0.97)]
)
def test_held_out_accuracy(spark, run, label, parts, part, least):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in run(docs, labels).collect()}
    assert len(rows) == docs.count()
    known = [(rows[r.doc_id], r[label]) for r in labels.collect() if crc32(str(r.doc_id).encode()) % parts == part]
    assert all(r.held_out and 0 <= r.score <= 1 for r, _ in known)
    assert sum(r.predicted == y for r, y in known) / len(known) >= least


def test_bounded_toxicity_sample_keeps_the_true_mix(spark, monkeypatch):
    """As many toxic as clean rows are learned from, where about one in nine is toxic."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 300)
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).collect()}
    known = [(rows[r.doc_id], r.toxic) for r in labels.collect() if crc32(str(r.doc_id).encode()) % 3 == 1]
    clean, toxic = ([p for p, y in known if y == k] for k in (0, 1))
    assert sum(clean) / len(clean) <= 0.01
    assert sum(toxic) / len(toxic) >= 0.5
    assert toxicity.needed(8000, 8000, {0: 8.0, 1: 1.0}) > toxicity.needed(1000, 8000, {0: 1.0, 1: 1.0}) == toxicity.SUPPORT


ODD = [(1, None, "a"), (2, "", "b"), (None, "some plain words of text", "c"), (3, "word " * 60_000, "d"), (3, "word", "e")]


@pytest.mark.parametrize("run", [quality.scored, toxicity.scored])
def test_odd_rows(spark, run):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 0, 1), (None, 1, 1), (99, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = run(docs, labels).collect()
        assert len(rows) == len(ODD)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert run(docs.limit(0), some).count() == 0


def test_kept_rows_are_whole(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet").limit(3000) for t in ("documents", "labels"))
    docs = docs.withColumnRenamed("source", "score")
    out = quality.kept(docs, labels)
    assert out.columns == docs.columns
    assert 0 < out.count() < docs.count()
    assert out.exceptAll(docs).isEmpty()


def test_repetition_has_a_vector_of_its_own():
    import numpy as np

    ids, hashes = np.array([0, 0, 0, 1, 2]), np.array([5, 6, 7], np.uint64)
    pairs, owner = subword.pair_buckets(ids, np.array([4, 1]), hashes)
    assert (pairs == subword.AGAIN).tolist() == [True, True, False]
    assert owner.tolist() == [0, 0, 0]
