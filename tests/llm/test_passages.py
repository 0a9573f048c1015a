import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerleaf.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(text, items, window):
    """Hit words and the items that have an occurring window."""
    words, hit, who = words_of(text), set(), set()
    for item, other in items:
        own = words_of(other)
        size = min(window, len(own))
        wanted = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in wanted:
                hit.update(range(k, k + size))
                who.add(item)
    return len(words), sorted(hit), sorted(i for i in who if i is not None)


few = st.lists(st.sampled_from("abc"), max_size=12).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(few, st.lists(few, max_size=4))
def test_automaton_equals_brute_force(text, others):
    items = [(str(k), t) for k, t in enumerate(others)]
    made = decontaminate.automaton([(i, decontaminate.words_of(t)) for i, t in items if t], 4)
    ids = np.array([made.vocabulary.get(w, -1) for w in decontaminate.words_of(text)], np.int64)
    hit, who = set(), set()
    for a, b, names in made.hits(ids):
        hit.update(range(a, b))
        who |= names
    assert (len(ids), sorted(hit), sorted(who)) == brute(text, items, 4)


LONG = " ".join(f"w{k % 997}" for k in range(30_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [
    (1, PASSAGE), (2, "Two three, FOUR five six seven eight nine ten eleven!"), (3, "rare phrase"), (None, "no name here at all"), (4, None), (5, "  ,.; "),
    (1, "another text of the same name"), (6, LONG), (7, "Élan vital ça"),
]
DOCS = [
    (1, f"Before. {PASSAGE.upper()} -- after", "x", 7), (2, "a rare  phrase, rare phrase", None, None), (3, None, None, None), (None, "", "x", 1), (4, "no name here at all", "x", 1),
    (4, "no name here at all", "x", 1), (5, "élan vital ça Élan", "x", 1), (6, LONG, "x", 1), (7, "three four five six seven eight nine ten eleven", "x", 1),
    (8, "another text of the same name", "x", 1), (9, "nothing of it", "x", 1),
]
SCHEMA = "doc_id long, text string, items string, n_words int"


@pytest.mark.parametrize("shard", [1 << 20, 1 << 12])
def test_summary_of_odd_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    monkeypatch.setattr(decontaminate, "PART", 15_000)
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.summary(docs, items).collect()
    want = []
    for key, text, *_ in DOCS:
        n, hit, who = brute(text, [(None if i is None else str(i), t) for i, t in ITEMS], 10)
        want.append((key, n, len(hit), len(who), sha256(",".join(who).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.summary(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.summary(docs, items.limit(0)).collect())


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([*DOCS[:5], (10, "x y z. " * 5 + PASSAGE + "; u v w", "x", 3)], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.removed(docs, items, share=0.6)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {3, None, 10}  # the others are mostly benchmark words
    assert rows[10].text == "x y z. " * 5 + "; u v w"
    assert rows[10].n_words == 3
    assert rows[3].text is None
    short = {r.doc_id: r.text for r in decontaminate.removed(docs, items, span=2, share=1.0).collect()}
    assert short[2] == "a "  # neighbouring spans are one
    assert short[1] == "Before.  -- after"
