"""Text classifier of supervised subword embeddings.

A document is the average of the vectors of its features: hashed words, hashed character
n-grams of the words, and hashed pairs of neighbouring words, where a word equal to the one
before is written as a back-reference, so that all repetitions share a vector. A softmax
layer reads the average. Vectors and layer are learned together by plain stochastic
gradient descent in numpy, in one task, on a bounded sample of labelled rows.

For scoring, the linear layer is applied to the vectors once: each bucket then has one
number, each distinct word one sum, and a document takes one pass over its words. Scoring
is narrow: no shuffle, memory bounded by a batch and ``WORDS`` remembered words.

Null and empty texts have no features and get the score of the bias alone. Without labels
of both classes every score is the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import small_batches
from ledgerleaf.llm.memory import returned

#: Labelled rows of each class that the model may learn from.
TRAIN_ROWS = 2_000
BUCKETS, SIZE, GRAMS = 1 << 16, 16, (3, 4, 5)
EPOCHS, RATE, SEED = 5, 2.0, 7
#: Distinct words remembered by a task, bytes of text read at once.
WORDS, TEXT = 300_000, 4 << 20
#: Bucket of a word that repeats the one before.
AGAIN = 0
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    """1 to BUCKETS - 1."""
    return (1 + (hashes * _MIX[0] >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, how many each word has, and the hash of each word."""
    raw = [f"<{w}>".encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    byte = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(len(byte))  # bytes up to the end of the word
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    at, found = [np.arange(len(raw))], [_bucket(whole)]
    owner = np.repeat(np.arange(len(raw)), size)
    h = np.zeros(len(byte), np.uint64)
    for k in range(max(GRAMS)):
        h[: len(byte) - k] = (h[: len(byte) - k] + byte[k:]) * _MIX[1] if k < len(byte) else h
        h ^= h >> np.uint64(29)
        if k + 1 in GRAMS:
            has = np.flatnonzero(room >= k + 1)
            at.append(owner[has])
            found.append(_bucket(h[has] + np.uint64(k)))
    at_all, all_ = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at_all, kind="stable")
    return all_[order], np.bincount(at_all, minlength=len(raw)), whole


class Words:
    """Numbers the distinct words that come; ``fresh`` says which are new."""

    def __init__(self):
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.hash = np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        known, split = len(self.number), [(t or "").split() for t in texts]
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        return ids, np.fromiter(map(len, split), np.int64, len(split)), list(self.number)[known:] if len(self.number) > known else []


def pair_buckets(ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words, and the text that each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    a, b = ids[inside], ids[inside + 1]
    pair = _bucket(hashes[a] * _MIX[2] + hashes[b] * _MIX[1])
    pair[a == b] = AGAIN
    return pair, owner[inside]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their counts for each training text."""
    for b in small_batches(batches, TEXT):
        words = Words()
        texts = b.column(0).to_pylist()
        ids, counts, fresh = words(texts)
        flat, size, hashes = word_features(fresh) if fresh else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(counts)), counts)
        n = size[ids]
        to = np.cumsum(n)
        own = flat[np.arange(to[-1] if len(to) else 0) + np.repeat(begin[ids] - (to - n), n)]
        pairs, pair_owner = pair_buckets(ids, counts, hashes)
        key = np.concatenate([np.repeat(owner, n), pair_owner]) * BUCKETS + np.concatenate([own, pairs])
        key, times = np.unique(key, return_counts=True)
        edges = np.searchsorted(key // BUCKETS, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x, pa.int32())) for x in ((key % BUCKETS).astype(np.int32), times.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*lists, b.column(1)], names=["buckets", "times", "label"])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float) -> tuple[np.ndarray, float]:
    """One number for each bucket, and the bias: the difference of the two classes' scores.

    ``share``: part of label 1 among all labels; the sample is balanced, so the bias is set right for it.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    layer, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    ones = sum(y for *_, y in rows)
    weight = {1: len(rows) / (2 * max(ones, 1)), 0: len(rows) / (2 * max(len(rows) - ones, 1))}
    steps = EPOCHS * len(rows)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, times, y = rows[i]
            part = (times / max(times.sum(), 1)).astype(np.float32)
            mean = part @ vectors[at]
            score = layer @ mean + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            pull = -p
            pull[y] += 1
            pull *= np.float32(RATE * (1 - step / steps) * weight[y])
            back = pull @ layer
            layer += np.outer(pull, mean)
            bias += pull * np.float32(0.1)
            # The average's share is given back by its root, as rare features learn too slowly else.
            vectors[at] += np.sqrt(part)[:, None] * back
            step += 1
    share = min(max(share, 1e-3), 1 - 1e-3)
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0] + np.log(share / (1 - share)))


def fit(rows: DataFrame, share: float | None) -> tuple[np.ndarray, float]:
    """Model from ``text, label`` rows: at most ``2 * TRAIN_ROWS``, learned in one task."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            edges = np.cumsum([0, *b.column(0).value_lengths().to_pylist()])
            at, times = (b.column(k).flatten().to_numpy().astype(np.int32) for k in (0, 1))
            found += [(at[x:y], times[x:y], label) for x, y, label in zip(edges, edges[1:], b.column(2).to_pylist())]
        if 0 < sum(y for *_, y in found) < len(found):
            found.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
            number, bias = train(found, share)
            yield pa.RecordBatch.from_arrays([pa.array([number.astype("<f4").tobytes()]), pa.array([bias])], names=["number", "bias"])

    features = rows.mapInArrow(returned(_featurise), "buckets array<int>, times array<int>, label int")
    # The rows are few; the texts are read and cut into features by as many tasks as there are.
    model = features.repartition(1).mapInArrow(returned(learn), "number binary, bias double").collect()
    if not model:
        share = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    return np.frombuffer(model[0].number, "<f4"), model[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_column: str = "text", name: str = "score") -> DataFrame:
    """All columns and ``name``, the probability of label 1."""
    number, bias = model
    names, text = docs.columns, docs.columns.index(text_column)
    held = docs.select(*((F.col(f"`{c}`").cast("string") if i == text else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(held.schema))
    # The model is 256 kB, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(number, np.float64), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, bias = shared.value
        words, total, size = Words(), np.zeros(0), np.zeros(0, np.int64)
        for b in small_batches(batches, TEXT):
            if len(words.number) > WORDS:
                words, total, size = Words(), np.zeros(0), np.zeros(0, np.int64)
            ids, counts, fresh = words(b.column(text).to_pylist())
            if fresh:
                flat, n, hashes = word_features(fresh)
                sums = np.add.reduceat(z[flat], np.cumsum(n) - n)
                total, size, words.hash = np.concatenate([total, sums]), np.concatenate([size, n]), np.concatenate([words.hash, hashes])
            owner = np.repeat(np.arange(len(counts)), counts)
            pairs, pair_owner = pair_buckets(ids, counts, words.hash)
            up = np.bincount(owner, total[ids], len(counts)) + np.bincount(pair_owner, z[pairs], len(counts))
            parts = np.bincount(owner, size[ids], len(counts)) + np.bincount(pair_owner, minlength=len(counts))
            out = 1 / (1 + np.exp(-np.clip(up / np.maximum(parts, 1) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*(f"c{i}" for i in range(len(names))), "score"])

    scored = held.mapInArrow(returned(run), f"{kinds}, score double")
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("score").alias(name))
