"""Toxicity of documents: a lexicon with misspellings, read in context.

The lexicon is the built-in list and the words that the labelled rows show to be toxic.
Every distinct word of a batch runs through the Levenshtein automaton of the lexicon. Each
hit gets a context score from the words and quotation marks around it: a term that is
quoted, named or reported counts as quotation, one next to an address of a person as
abuse. A document's score is a logistic function of its summed hits, fitted to labelled
rows. The sample of these is bounded by class, so its rows are weighted back to the true
shares of the classes: lexicon and scores mean the same at every size.

Null and empty texts have no hits and get the score of the intercept. Scoring is narrow:
no shuffle; the lexicon is bounded by ``TERMS``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import labelled
from ledgerleaf.llm.automaton import Automaton
from ledgerleaf.llm.bpe import small_batches

#: Labelled rows of each class that lexicon and weights may be learned from.
TRAIN_ROWS = 8_000
#: Terms at most, unrelated toxic texts that a learned term needs in a sample of the true mix, and the share of them among its texts at true rates.
TERMS, SUPPORT, SHARE = 2_000, 4, 0.9
TOXIC = 0.7
#: Words on either side that a context score looks at.
WINDOW = 4
WORDS = 600_000

WORD = re.compile(r"[^\W_]+")
#: Insults that count without any label.
INSULTS = (
    "clown disgusting idiot imbecile loser moron pathetic scum stupid trash vermin worthless "
    "bastard cretin degenerate dimwit dumbass filthy halfwit lowlife nitwit parasite scumbag subhuman"
).split()
REPORTS = set(
    "said says say wrote writes called calls calling named term word words phrase quote quoted quotes insult insults slur "
    "sagte schrieb wort begriff dijo llamó palabra término mot terme écrit".split()
)
ADDRESSES = set("you your youre yourself u ur du dich dein deine ihr euch tu te tú usted vous toi ton ta are such".split())
QUOTES = "\"“”„«»‘’'`"

#: Sums of the weights of hits, by exactness and context, and whether there is one at all.
FEATURES = ["exact", "exact_quoted", "near", "near_quoted", "any_exact", "any_near"]


def _quoted(text: str, start: int, end: int) -> bool:
    return start > 0 and end < len(text) and text[start - 1] in QUOTES and (text[end] in QUOTES or text[end : end + 2].strip(".,;:!?")[:1] in tuple(QUOTES))


def context(text: str, spans: list[tuple[int, int]], k: int) -> float:
    """Share of abuse in a hit, 0 (quotation) to 1."""
    if _quoted(text, *spans[k]):
        share = 0.25
    else:
        share = 0.8
    for a, b in spans[max(0, k - WINDOW) : k]:
        if text[a:b].lower() in REPORTS:
            share -= 0.3
    for a, b in spans[max(0, k - WINDOW) : k] + spans[k + 1 : k + 1 + WINDOW]:
        if text[a:b].lower() in ADDRESSES:
            share += 0.2
    return min(max(share, 0.0), 1.0)


class Reader:
    """Features of texts; remembers which distinct words hit."""

    def __init__(self, weights: dict[str, float]):
        self.automaton = Automaton(list(weights))
        self.weights = weights
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """``start, end, term, edits, abuse share`` of every hit."""
        words = WORD.findall(text)
        known = self.known
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.automaton.match(w.lower())
        if not any(map(known.__getitem__, set(words))):
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        found = [(k, known[w]) for k, w in enumerate(words) if known[w]]
        return [(*spans[k], self.automaton.terms[t], e, context(text, spans, k)) for k, (t, e) in found]

    def features(self, text: str) -> list[float]:
        sums = [0.0] * len(FEATURES)
        for *_, term, e, share in self.hits(text):
            w = self.weights[term]
            at = 0 if e == 0 else 2
            sums[at] += w * share
            sums[at + 1] += w * (1 - share)
            sums[4 + (e > 0)] = 1.0
        return [math.log1p(x) for x in sums[:4]] + sums[4:]


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of each text, with a signature that near copies share: the text's smallest word hash."""
    for b in small_batches(batches):
        term, label, mark = [], [], []
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = {w.lower() for w in WORD.findall(text)}
            words = [w for w in words if 3 <= len(w) <= 40]
            least = min((zlib.crc32(w.encode()) for w in words), default=0)
            term += words
            label += [y] * len(words)
            mark += [least] * len(words)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(label, pa.int32()), pa.array(mark, pa.int64())], names=["term", "label", "mark"])


def needed(toxic: float, clean: float, weights: dict[int, float]) -> int:
    """Toxic texts that are as unlikely by chance in a sample of so many rows as SUPPORT ones in the true mix."""
    true = toxic * weights[1] / (toxic * weights[1] + clean * weights[0])
    return max(SUPPORT, math.ceil(SUPPORT * math.log(true) / math.log(toxic / (toxic + clean)) - 1e-9))


def lexicon(rows: DataFrame, support: int = SUPPORT, weights: dict[int, float] | None = None) -> dict[str, float]:
    """Terms and weights: the built-in ones, and words found in toxic rows almost only, each row counted by the weight of its class."""
    by = weights or {0: 1.0, 1: 1.0}
    seen = rows.mapInArrow(_terms_of, "term string, label int, mark bigint").distinct()
    counts = seen.groupBy("term").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("all"))
    toxic, clean = F.col("toxic") * by[1], (F.col("all") - F.col("toxic")) * by[0]
    good = counts.filter((F.col("toxic") >= support) & (toxic >= SHARE * (toxic + clean)))
    best = good.orderBy(F.col("toxic").desc(), "term").limit(TERMS).collect()
    return dict.fromkeys(INSULTS, 2.0) | {r.term: min(4.0, 1.0 + math.log(r.toxic)) for r in best}


#: Weights before any label, towards which the fit is drawn: features, then intercept.
PRIOR = np.array([2.0, 0.2, 0.6, 0.0, 1.0, 0.0, -3.5])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", parts: int = 3, part: int = 1) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights; without labels of both classes the built-in ones."""
    out = labelled.held_out(id_column, parts, part)
    rows = labelled.sample(docs, labels, label, out, TRAIN_ROWS, id_column).persist()
    held = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(held) < 2:
        rows.unpersist()
        return dict.fromkeys(INSULTS, 2.0), PRIOR
    stands = labelled.weights(labels, label, out, TRAIN_ROWS, id_column)
    weights = lexicon(rows, needed(held[1], held[0], stands), stands)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights)
        for b in batches:
            values = np.array([reader.features(t) for t in b.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in values.T), b.column(1)], names=[*FEATURES, "label"])

    # Six numbers a row, and equal rows counted: the sample is bounded by TRAIN_ROWS.
    found = rows.mapInArrow(read, ", ".join(f"{c} double" for c in FEATURES) + ", label int")
    table = np.array([list(r) for r in found.groupBy(*FEATURES, "label").count().collect()], float).reshape(-1, len(FEATURES) + 2)
    rows.unpersist()
    y, times = table[:, -2], table[:, -1]
    # True shares, as many rows as the sample has.
    times = times * np.where(y == 1, stands[1], stands[0])
    times *= table[:, -1].sum() / times.sum()
    x = np.column_stack([table[:, :-2], np.ones(len(table))])
    w = PRIOR.copy()
    for _ in range(40):  # Newton steps of the drawn-back logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (p - y)) + (w - PRIOR)
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return weights, w


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, held_out, score, predicted, n_hits`` of every row."""
    weights, w = fit(docs, labels, id_column=id_column)
    shared = docs.sparkSession.sparkContext.broadcast((weights, w))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, w = shared.value
        reader = Reader(weights)
        for b in small_batches(batches):
            values = np.array([reader.features(t or "") for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(values @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return rows.select(F.col("id").alias(id_column), labelled.held_out("id", 3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
