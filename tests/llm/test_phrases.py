import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerleaf.llm import collocations


def brute(docs, depth=3, least=10, top=2000, cover=50):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, depth + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    kept = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    inside = Counter()
    for (lang, *w), a in kept.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[(lang, *w[i : i + k])] = max(inside[(lang, *w[i : i + k])], a)
    rows = {}
    for (lang, *w), a in kept.items():
        if 100 * inside[(lang, *w)] >= cover * a:
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    out = []
    for lang, some in rows.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(some)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def everything(bits=16):
    return collocations.Filter(bits, np.full((1 << bits) // 8, 255, np.uint8))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 5))
def test_levels_equal_plain_counting(symbols, depth):
    sequence = np.array([*symbols, 0])
    hashes = np.arange(5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    phrases, times = collocations.levels(sequence, hashes, [everything()] * (depth - 1))
    got = {tuple(p): t for p, t in zip(phrases.tolist(), times.tolist())}
    windows = [tuple(sequence[i : i + depth].tolist()) for i in range(len(sequence) - depth + 1)]
    assert got == Counter(w for w in windows if 0 not in w)


def test_index_steps_equal_a_sorted_list():
    rng = np.random.default_rng(3)
    s = np.append(rng.integers(0, 6, 500), 0)
    twice = np.concatenate([s, s])
    suffixes = sorted(tuple(twice[i : i + 4].tolist()) for i in range(len(s)))
    index = collocations.Index(s, 4)
    for _ in range(50):
        i = int(rng.integers(1, 490))
        if 0 in s[i - 1 : i + 3]:
            continue
        phrase = tuple(s[i : i + 3].tolist())
        low, high = (next((k for k, x in enumerate(suffixes) if x[:3] >= y), len(s)) for y in (phrase, (*phrase[:2], phrase[2] + 1)))
        owner, symbol, times, below = index.extend(np.array([low]), np.array([high - low]))
        before = Counter(int(s[k - 1]) for k in range(len(s)) if tuple(twice[k : k + 3].tolist()) == phrase)
        assert dict(zip(symbol.tolist(), times.tolist())) == {c: n for c, n in before.items() if c}
        assert below.tolist() == [sum(n for x, n in before.items() if x < c) for c in symbol.tolist()]
        start = index.start(symbol, np.full(len(symbol), low))
        assert [suffixes[k] for k in start.tolist()] == [(c, *phrase) for c in symbol.tolist()]


@pytest.mark.parametrize("shard", [8 << 20, 200])
def test_mined_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    rng = np.random.default_rng(5)
    words = ["the", "New", "york", "city", "É", "of", "a-b", "x'", "ß", "the"]
    rows = [(["en", "de", None][i % 3], " ".join(rng.choice(words, int(rng.integers(1, 30)))) + "." + "\tNew  York City!" * (i % 3)) for i in range(300)]
    rows += [(None, None), ("en", ""), ("fr", ". , ;"), ("en", "un\x0bbroken\x85line " * 12), ("de", "ja " * 50_000), ("en", "solo,")]
    docs = spark.createDataFrame([(i % 7, t, lang, "c", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f int").repartition(4)
    got = collocations.mined(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert sorted(map(tuple, collocations.mined(docs, depth=4, least=4, top=5, cover=80).collect())) == brute(rows, 4, 4, 5, 80)


def test_scores_beyond_64_bits(spark):
    """10^6 a^2 and l r pass 64 bits."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(3_000_000_000_000).alias("a"), F.lit(4_000_000_000_001).alias("l"), F.lit(3_000_000_000_007).alias("r"))
    up = F.lit(1_000_000).cast("decimal(38,0)") * collocations._exact("a") * collocations._exact("a")
    got = row.withColumns({"up": up, "down": collocations._exact("l") * collocations._exact("r")}).select(F.expr("up div down")).first()[0]
    assert got == 10**6 * 3_000_000_000_000**2 // (4_000_000_000_001 * 3_000_000_000_007)


def test_empty_table(spark):
    assert collocations.mined(spark.createDataFrame([], "text string, lang string")).count() == 0
