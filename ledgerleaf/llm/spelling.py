"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word is the vector of its letter counts. One replaced letter moves that vector by a squared
distance of two, one inserted or deleted letter by one, so words at edit distance one are
never further apart. Within a block the squared distances of all words come from one numpy
product of the block's count matrix with itself, taken for words of the same and of the next
length only; pairs at a distance of one or two are then verified letter by letter.

Blocks: the letters are dealt into ``GROUPS`` groups. An edit changes the counts in at most
two groups, so in some choice of ``GROUPS - 2`` groups both words agree in full. A word goes
into one block for each choice, named by its counts there; a pair is taken in the first
choice that holds it. A block of more than ``TILE`` words is cut into tiles that meet
pairwise, so that no task holds a large block. What leaves a task is one row for each word of
a product: its near words' number, and the most frequent of them.

Null texts have no words; null identifiers count as empty. Without words there are no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.session import saved
from ledgerleaf.llm.bpe import small_batches

SHORTEST, LEAST, RATIO = 7, 2, 10
#: Groups of letters; words of a block that meet in one task; rows and words of a product.
GROUPS, TILE, ROWS = 5, 8192, 128
#: Distinct words that a task counts before it lets them go, bytes of text read at once.
HELD, TEXT = 200_000, 4 << 20
#: Letters: a to z and the code points C0 to FF, which one byte each holds in Latin-1.
LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])
_RUN_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c in LETTERS else 32 for c in range(256))
_COLUMN = np.zeros(256, np.int64)
_COLUMN[list(LETTERS)] = np.arange(len(LETTERS))
CHOICES = list(combinations(range(GROUPS), GROUPS - 2))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case, as Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_RUN_BYTES).split()


def word_counts(docs: DataFrame, every: int | None = None, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` letters and ``least`` occurrences.

    ``every``: where it divides the CRC-32 ``h`` of ``id:word``, the letter ``h % length`` is left out first.
    """

    def rows(total: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in total]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in small_batches(batches, TEXT):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = Counter(w for w in runs_of(text) if len(w) >= shortest)
                if not every:
                    total.update(runs)
                    continue
                front = crc32(f"{key or ''}:".encode())
                for w, n in runs.items():
                    h = crc32(w if w.isascii() else w.decode("latin-1").encode(), front)
                    if h % every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < shortest:
                            continue
                    total[w] += n
            if len(total) > HELD:
                yield rows(total)
                total = Counter()
        yield rows(total)

    texts = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def count_matrix(words: list[bytes], kind: type = np.int64) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), size) * len(LETTERS) + _COLUMN[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * len(LETTERS)).reshape(len(words), len(LETTERS)).astype(kind)


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each letter, so that the groups' counts differ about equally much among the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(LETTERS)))
        for b in small_batches(batches, TEXT >> 3):
            if b.num_rows:
                counts = count_matrix([w.encode("latin-1") for w in b.column(0).to_pylist()], np.float64)
                sums += counts.sum(0), (counts**2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(LETTERS)), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["letter", "s", "q"])

    sums = words.select("word").mapInArrow(run, "letter int, s double, q double").groupBy("letter").agg(F.sum("s"), F.sum("q")).collect()
    n = max(words.count(), 1)
    spread = {letter: q / n - (s / n) ** 2 for letter, s, q in sums}  # one number for each letter, whatever the input
    group, load = np.zeros(len(LETTERS), np.int64), np.zeros(GROUPS)
    for letter in sorted(spread, key=lambda x: (-spread[x], x)):
        group[letter] = load.argmin()
        load[group[letter]] += spread[letter]
    return group


def _blocks(group: np.ndarray):
    """``choice, block, word, n`` of a word for each choice of groups."""
    weight = np.random.default_rng(31).integers(1, 1 << 63, len(LETTERS), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, TEXT >> 4):
            if b.num_rows:
                counts = count_matrix([w.encode("latin-1") for w in b.column(0).to_pylist()], np.uint64)
                for k, choice in enumerate(CHOICES):
                    block = (counts * np.where(np.isin(group, choice), weight, np.uint64(0))).sum(1, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b.num_rows, k, np.int8)), pa.array(block), b.column(0), b.column(1)], names=["choice", "block", "word", "n"]
                    )

    return run


def one_edit(words: list[bytes], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are exactly one edit apart; ``b`` is as long as ``a`` or one letter longer."""
    out = np.zeros(len(a), bool)
    for l in np.unique(size[a]).tolist():
        for more in (0, 1):
            at = np.flatnonzero((size[a] == l) & (size[b] == l + more))
            step = max(1, (4 << 20) // l)
            for part in (at[k : k + step] for k in range(0, len(at), step)):
                x = np.frombuffer(b"".join(words[i] for i in a[part].tolist()), np.uint8).reshape(-1, l)
                y = np.frombuffer(b"".join(words[i] for i in b[part].tolist()), np.uint8).reshape(-1, l + more)
                if more:
                    front = np.cumprod(x == y[:, :-1], axis=1).sum(1)
                    back = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
                    out[part] = front + back >= l
                else:
                    out[part] = (x != y).sum(1) == 1
    return out


def near_pairs(words: list[bytes], block: np.ndarray, side: np.ndarray, crossed: np.ndarray, choice: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart in the same block; rows are sorted by block and length.

    ``crossed`` blocks hold two tiles, and only pairs of different ``side`` count.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    # Counts up to 2000 give squares that single precision holds exactly.
    counts = count_matrix(words, np.float32 if size.max() <= 2000 else np.float64)
    square = (counts**2).sum(1)
    place = block * (size.max() + 2) + size
    reach = np.searchsorted(place, place + 1, "right")  # behind the block's words that are at most one longer
    left, right = [], []
    for begin in range(0, len(words), ROWS):
        end = min(begin + ROWS, len(words))
        for c in range(begin, int(reach[end - 1]), 16 * ROWS):
            d = min(c + 16 * ROWS, int(reach[end - 1]))
            distance = square[begin:end, None] + square[None, c:d] - 2 * (counts[begin:end] @ counts[c:d].T)
            a, b = np.nonzero((distance <= 2) & (distance > 0))
            a, b = a + begin, b + c
            fits = (b > a) & (b < reach[a]) & (~crossed[a] | (side[a] != side[b]))
            a, b = a[fits], b[fits]
            good = one_edit(words, size, a, b)
            left.append(a[good])
            right.append(b[good])
    a, b = np.concatenate(left), np.concatenate(right)
    differs = counts[a] != counts[b]
    same = np.stack([~differs[:, group == g].any(1) for g in range(GROUPS)])
    first = np.full(len(a), -1)
    for k in reversed(range(len(CHOICES))):
        first[same[list(CHOICES[k])].all(0)] = k
    own = first == choice[a]
    return a[own], b[own]


def _products(group: np.ndarray):
    """``word, n_near, best_n, best`` of rows sorted by block and length."""
    names = ["word", "n_near", "best_n", "best"]

    def solve(rows: pa.RecordBatch, block: np.ndarray) -> pa.RecordBatch:
        choice, i, j, side, n = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("choice", "i", "j", "tile", "n"))
        words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
        a, b = near_pairs(words, block, side, i != j, choice, group)
        source, near = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.zeros(len(words), np.int64)
        used = np.unique(near).tolist()
        rank[sorted(used, key=words.__getitem__)] = np.arange(len(used))
        order = np.lexsort((rank[near], -n[near], source))
        source, near = source[order], near[order]
        at, first, count = np.unique(source, return_index=True, return_counts=True)
        best = near[first]
        text = rows.column("word")
        return pa.RecordBatch.from_arrays([text.take(pa.array(at)), pa.array(count, pa.int64()), pa.array(n[best]), text.take(pa.array(best))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows, block = blocks(held)
                last = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if last:
                    yield solve(rows.slice(0, last), block[:last])
                held = [rows.slice(last)]
        if held:
            yield solve(*blocks(held))

    def blocks(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(rows.num_rows, bool)
        for k in ("choice", "block", "i", "j"):
            x = rows.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return rows, np.cumsum(new)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of every word that has a near word; best: largest ``n``, then first in code-point order."""
    group = letter_groups(words)
    rows = words.select("word", "n").mapInArrow(_blocks(group), "choice tinyint, block bigint, word string, n bigint")
    sizes = rows.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("size"))
    hot = sizes.filter(F.col("size") > TILE).select("choice", "block", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    tiled = rows.join(hot, ["choice", "block"], "left").withColumn("tile", F.pmod(F.xxhash64("word"), F.coalesce("tiles", F.lit(1))).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
    met = tiled.select("choice", "block", "tile", "word", "n", others.alias("other"))
    keys = ["choice", "block", "i", "j"]
    met = met.select("choice", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "word", "n")
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, F.char_length("word"), "word")
    found = dealt.mapInArrow(_products(group), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    total = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return total.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``word, n``.

    A form is at least ``ratio`` times as frequent as its word, so chains are short (19 steps in
    64 bits) and free of circles; the steps to the root are doubled in each round.
    """
    near = near_words(words)
    is_form = F.expr(f"best_n div {ratio}") >= F.col("n")  # a product may pass 64 bits
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(is_form, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    rows = saved(rows, "forms")
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = saved(moved, "roots")
        roots = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, every: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return variants(saved(word_counts(docs, every, id_column, text_column), "words"))
