"""Rule tables: the automaton against plain search."""

import random
import tracemalloc

import pytest
from helpers import parsed
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf.operators import keywords
from ledgerleaf.operators.classify import classify
from ledgerleaf.rules import BUILTIN_RULES

SCHEMA = "rule_no int, doc_type string, primary array<string>, secondary array<string>, headers array<string>, negative array<string>"


def table(spark, rules):
    return spark.createDataFrame(rules, SCHEMA)


def searched(rules, corpus, headers):
    """Points and number of the best rule, by a search for every word."""
    best = (0, None)
    for number, _, primary, secondary, heads, negative in sorted(rules, key=lambda r: r[0]):
        if any(w in corpus for w in negative):
            continue
        points = K.PRIMARY_POINTS * sum(w in corpus for w in primary) + K.SECONDARY_POINTS * sum(w in corpus for w in secondary)
        points = min(K.MAX_POINTS, points + K.HEADER_POINTS * sum(w in headers for w in heads))
        if points > best[0]:
            best = (points, number)
    return best


words = st.lists(st.text("AB ", max_size=3), max_size=3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(words, words, words, st.lists(st.text("ABC", min_size=2, max_size=3), max_size=1)), max_size=6), st.text("ABC ", max_size=12), st.text("AB ", max_size=5))
def test_matcher_equals_plain_search(lists, corpus, headers):
    rules = [(n, f"T{n}", *four) for n, four in enumerate(lists)]
    points, order, doc_type, *_ = keywords.Matcher(rules).best(corpus, headers)
    want, number = searched(rules, corpus, headers)
    assert points == want
    if want:
        assert (order, doc_type) == (-number, f"T{number}")


def shown(df):
    return sorted((r.document_id, r.document_type, r.confidence, tuple(r.matched_rules), r.reason) for r in df.collect())


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(5)
    every = [w for r in BUILTIN_RULES for w in (*r.primary, *r.secondary, *r.negative)]
    heads = [w for r in BUILTIN_RULES for w in r.headers]
    made = [(f"d{n}", " x ".join(draw.sample(every, draw.randrange(6))), [["1"]], draw.sample(heads, draw.randrange(4))) for n in range(60)]
    return parsed(spark, *made, ("empty", ""))


def test_table_of_builtin_rules_equals_literals(spark, documents):
    rules = table(spark, [(n, r.doc_type, list(r.primary), list(r.secondary), list(r.headers), list(r.negative)) for n, r in enumerate(BUILTIN_RULES)])
    assert shown(classify(documents, rules)) == shown(classify(documents))


def test_slices_give_the_same_rows(spark, documents, monkeypatch):
    rules = table(spark, [(n, r.doc_type, list(r.primary), list(r.secondary), list(r.headers), list(r.negative)) for n, r in enumerate(BUILTIN_RULES)])
    whole = shown(classify(documents, rules))
    real, sliced = keywords.with_best_rule, []

    def small(*args):
        sliced.append(args[1].count())
        return real(*args, at_once=600)

    monkeypatch.setattr(keywords, "with_best_rule", small)
    assert shown(classify(documents, rules)) == whole and sliced == [len(BUILTIN_RULES)]


def test_fifty_thousand_rules(spark):
    draw = random.Random(11)
    name = lambda: "".join(draw.choices("ABCDEFGH", k=draw.randint(3, 9)))
    rules = [(n, f"T{n}", [name(), "INVOICE"] if n % 3 == 0 else [name()], [name()], [name()], [name()] if n % 5 == 0 else []) for n in range(50_000)]
    texts = [(f"d{n}", "".join(draw.choices("ABCDEFGH ", k=300)) + " invoice" * (n % 2)) for n in range(12)]
    got = {r.document_id: r for r in classify(parsed(spark, *texts), table(spark, rules)).collect()}
    for key, body in texts:
        points, number = searched(rules, body.upper(), "")
        assert got[key].confidence == points / 100.0
        assert got[key].document_type == (f"T{number}" if points >= K.THRESHOLD_POINTS else K.UNKNOWN)


def test_odd_rule_tables(spark):
    docs = parsed(spark, ("a", "alpha beta"), ("n", ""))
    rules = table(
        spark,
        [
            (2, "late", ["ALPHA"], None, None, [None]),
            (1, "vetoed", ["ALPHA", "BETA"], [], [], ["A B"]),
            (1, "first", ["ALPHA", None], [None], [], None),
            (1, "first", ["ALPHA", None], [None], [], None),
            (None, "numberless", ["ALPHA"], [], [], []),
            (3, "empty word", [""], [], [], []),
        ],
    )
    got = {r.document_id: r for r in classify(docs, rules).collect()}
    assert (got["a"].document_type, got["a"].matched_rules) == ("first", ["Primary: 'ALPHA'"])
    assert got["n"].document_type == "empty word"
    assert classify(docs.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="empty"):
        classify(docs, rules.limit(0))


def test_no_shuffle_of_documents(spark, documents):
    rules = table(spark, [(1, "t", ["INVOICE"], [], [], [])])
    plan = classify(documents, rules).filter(F.col("confidence") > 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_classes_of_rules_give_the_rules_scored_one_by_one(monkeypatch):
    rng = random.Random(11)
    pick = lambda n: tuple(rng.choice(["AB", "B", "CD", "D", "XY", "", "Q"]) for _ in range(rng.randrange(n)))
    rules = [(rng.choice([None, *range(60)]), f"t{i % 9}", (f"N{i % 120}.", *pick(3)), pick(3), pick(2), (f"M{i % 50}.",) * (i % 3 == 0) + pick(2)[:i % 7 == 0]) for i in range(150)]
    texts = [(" ".join(rng.sample(["AB", "CD", "XY", "QQ", f"N{rng.randrange(130)}.", f"M{rng.randrange(60)}."], rng.randrange(7))), rng.choice(["", "AB", "XY D", None])) for _ in range(300)]
    want = None
    for common in (10**9, 5, 0):
        monkeypatch.setattr(keywords, "COMMON", common)
        matcher = keywords.Matcher(rules)
        got = [matcher.best(*t) for t in texts]
        want = want or got
        assert got == want and len({g[:2] for g in got}) > 3


def test_a_word_of_many_rules_costs_its_classes():
    rules = [(i, f"t{i}", (f"N{i}.",), ("SHARED",), (), (f"V{i % 10}.",)) for i in range(20_000)]
    matcher = keywords.Matcher(rules)
    assert sum(map(len, matcher.worth.values())) <= 30  # 40,000 votes before
    assert matcher.best("SHARED N7.", None)[1] == -7
    assert matcher.best("SHARED V0. V1.", None)[1] == -2
    assert matcher.best("SHARED V0. N0. N1.", None)[1] == -1


def test_memory_of_a_task_is_bounded(monkeypatch):
    """Rules are arrays, and what is remembered of the documents does not grow with them."""
    monkeypatch.setattr(keywords, "REMEMBERED", 1 << 16)
    # Every rule has one of 20 * 20 * 2 sets of common words.
    rules = [(i, f"t{i}", (f"N{i}.",), (f"S{i % 20}.",), ("QTY",) if i % 7 else (), (f"V{i // 20 % 20}.",)) for i in range(60_000)]
    table = keywords._in_order(rules)
    tracemalloc.start()
    matcher = keywords.Matcher(table)
    assert tracemalloc.get_traced_memory()[0] < 12 << 20
    texts = [" ".join(f"V{j}." for j in range(20) if n >> j & 1) + f" S{n % 20}. N{n}." for n in range(600)]
    got = [matcher.best(t, "QTY")[:2] for t in texts]
    assert tracemalloc.get_traced_memory()[0] < 13 << 20
    tracemalloc.stop()
    for n in range(0, 600, 37):
        plain = searched([r for r in rules if r[0] < 800 or r[0] == n], texts[n], "QTY")
        assert got[n] == (plain[0], -plain[1])
