"""Phrases mined from an FM-index over word ids in each shard, summed across shards.

A shard is a bounded stretch of a task's texts. Its words get numbers, one sequence holds all
pieces with a mark between them, and two indexes are built: the Burrows-Wheeler transform of
the sequence, and that of the reversed sequence. A phrase is a pair of intervals, one in each;
extending it by a word on the left is a step in the first index, on the right one in the
second, and the number of smaller neighbours keeps both intervals in step. All phrases of a
level are extended at once in numpy. Suffixes are sorted by their first words only, as far as
the depth needs.

Levels follow one another over the whole table: words, pairs, triples. A phrase of a level
leaves a shard only if both its parts one word shorter may reach ``least`` occurrences in the
table. Which do is told by a filter of ``FILTER_BITS`` bits at most, so what is broadcast is
bounded; a filter may let too much pass, never too little, and the sums across shards decide.
Shards send each phrase once, with its count, so a frequent phrase is no hot key.

Null texts count as empty, a null ``lang`` as ``und``; identifiers are not read. Empty texts
and empty tables give no rows. Repeated rows count each time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.session import saved
from ledgerleaf.llm.bpe import small_batches

DEPTH, LEAST, TOP, COVER = 3, 10, 2000, 50
#: Bytes of text in a shard, bytes read at once.
SHARD, TEXT = 8 << 20, 2 << 20
#: Bits of a filter: sixteen for each phrase, as a power of two, within these bounds; cut into BLOCKS parts.
FILTER_LOW, FILTER_BITS, BLOCKS = 16, 26, 64
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A byte that no text in UTF-8 holds stands for the end of a piece.
_STOP = b"\xff"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in ENDS else 32 if c == 9 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; a stop between pieces."""
    return (text or "").encode().translate(_TABLE).replace(_STOP, b" \xff ").split()


class Index:
    """Burrows-Wheeler transform of a sequence whose suffixes are sorted by at least ``depth`` symbols.

    Phrases of up to ``depth`` words are intervals of it. Symbol 0 separates pieces.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        rank, width = sequence.astype(np.int64), 1
        order = np.argsort(rank)
        while width < depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.append(False, sorted_key[1:] != sorted_key[:-1]))
            width *= 2
        self.n, self.symbols = len(sequence), int(sequence.max()) + 1
        self.bwt = sequence[order - 1].astype(np.int64)

    @cached_property
    def keys(self) -> np.ndarray:
        """Symbol and row of the transform in ascending order: a place here is a place among the suffixes."""
        return np.sort(self.bwt * self.n + np.arange(self.n))

    def start(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First suffix of the extension: all smaller symbols, and the same symbol before the row."""
        return np.searchsorted(self.keys, symbol * self.n + row)

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all intervals: interval extended, symbol, size of the new interval, and number of smaller neighbours."""
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        key = np.sort(owner * self.symbols + self.bwt[rows])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        owner, symbol = key[first] // self.symbols, key[first] % self.symbols
        below = first - (np.cumsum(size) - size)[owner]
        word = symbol > 0
        owner, symbol, times, below = owner[word], symbol[word], times[word], below[word]
        return owner, symbol, times, below


def mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of word hashes."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
    return out


class Filter:
    """Bits of the hashes of phrases; a phrase that was not added mostly has none."""

    def __init__(self, bits: int, raw: np.ndarray):
        self.bits, self.raw = bits, raw

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def levels(sequence: np.ndarray, hashes: np.ndarray, filters: list[Filter]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``len(filters) + 1`` words as rows of symbols, and their counts; ``hashes`` are those of the symbols."""
    depth = len(filters) + 1
    if depth == 1:
        times = np.bincount(sequence, minlength=len(hashes))
        times[0] = 0
        words = np.flatnonzero(times)
        return words[:, None], times[words]
    good = filters[0].may_hold(mixed([hashes]))
    good[0] = False
    sequence = np.where(good[sequence], sequence, 0)
    # Of neighbouring marks one is enough.
    sequence = sequence[np.append(True, (sequence[1:] != 0) | (sequence[:-1] != 0))]
    sequence = np.append(sequence, 0) if sequence[-1] else sequence
    times = np.bincount(sequence, minlength=len(hashes))
    begin = np.cumsum(times) - times
    words = np.flatnonzero(times[1:]) + 1
    phrases, low, back, size = words[:, None], begin[words], begin[words], times[words]
    if not len(words):
        return np.zeros((0, depth), np.int64), size
    # Steps to the right (even levels) use the second index, steps to the left the first; a step from d words needs d sorted symbols.
    behind = Index(sequence[::-1], depth - 1 - depth % 2)
    ahead = Index(sequence, depth - 2 + depth % 2) if depth > 2 else None
    for d in range(2, depth + 1):
        if d % 2:
            owner, symbol, size, below = ahead.extend(low, size)
            if d < depth:
                low, back = ahead.start(symbol, low[owner]), back[owner] + below
            phrases = np.column_stack([symbol, phrases[owner]])
            other = phrases[:, :-1]
        else:
            owner, symbol, size, below = behind.extend(back, size)
            if d < depth:
                low, back = low[owner] + below, behind.start(symbol, back[owner])
            phrases = np.column_stack([phrases[owner], symbol])
            other = phrases[:, 1:]
        if d < depth:
            fits = filters[d - 1].may_hold(mixed([hashes[c] for c in phrases.T]))
        else:
            fits = filters[d - 2].may_hold(mixed([hashes[c] for c in other.T]))
            return phrases[fits], size[fits]
        phrases, low, back, size = phrases[fits], low[fits], back[fits], size[fits]


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


class _Shard:
    """Texts of all languages in one sequence; equal words of two languages are two symbols."""

    def __init__(self):
        self.number: dict[str, dict[bytes, int]] = {}
        self.next = count(1)
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, texts: list[str | None]) -> None:
        if lang not in self.number:
            self.number[lang] = defaultdict(self.next.__next__, {_STOP: 0})
        number = self.number[lang]
        known = len(number)
        split = list(map(tokens, texts))
        for words in split:
            words.append(_STOP)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        fresh = list(number)[known:]
        self.words += fresh
        self.langs += [lang] * len(fresh)
        self.parts.append(ids)
        self.size += len(ids)

    def phrases(self, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
        hashes = np.zeros(len(self.words) + 1, np.uint64)
        hashes[1:] = [word_hash(a, w) for a, w in zip(self.langs, self.words)] if filters else 0
        found, times = levels(np.concatenate(self.parts), hashes, filters)
        words = pa.array([None, *self.words], pa.binary()).cast(pa.string())
        langs = pa.array([None, *self.langs], pa.string())
        step = 100_000
        for k in range(0, len(found), step):
            part = found[k : k + step]
            columns = [words.take(pa.array(c)) for c in part.T]
            phrase = pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(part[:, 0])), phrase, pa.array(times[k : k + step], pa.int64())], names=["lang", "phrase", "f"])


def counted(texts: DataFrame, filters: list[Filter]) -> DataFrame:
    """``lang, phrase, f`` of the phrases of the next level, whatever their count; ``texts`` has ``lang, text``."""
    shared = texts.sparkSession.sparkContext.broadcast([(f.bits, f.raw) for f in filters])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(*x) for x in shared.value]
        shard, size = _Shard(), 0
        for b in small_batches(batches, TEXT):
            by_lang: dict[str, list] = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang[lang].append(text)
            for lang, some in by_lang.items():
                shard.add(lang, some)
            size += b.nbytes
            if size >= SHARD:
                yield from shard.phrases(filters)
                shard, size = _Shard(), 0
        if shard.parts:
            yield from shard.phrases(filters)

    found = texts.mapInArrow(run, "lang string, phrase string, f bigint")
    # Shards have summed already: summing again before the shuffle would only cost time.
    return found.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_filter(phrases: DataFrame) -> Filter:
    """Filter over the rows' phrases: parts of it are made in tasks, their sizes are fixed."""
    n = phrases.count()
    bits = min(max(FILTER_LOW, (16 * max(n, 1)).bit_length()), FILTER_BITS)
    per = (1 << bits) // BLOCKS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = phrase.encode().split(b" ")
                hashes.append([word_hash(lang, w) for w in words])
            if hashes:
                mix = mixed([np.array(c, np.uint64) for c in zip(*hashes)])
                at = (mix >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // per), pa.array(at % per)], names=["block", "bit"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(per, bool))
        for b in batches:
            which, at = (c.to_numpy() for c in b.columns)
            for k in np.unique(which).tolist():
                maps[k][at[which == k]] = True
        raw = [np.packbits(m, bitorder="little").tobytes() for m in maps.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int64()), pa.array(raw, pa.binary())], names=["block", "raw"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "block bigint, bit bigint").distinct()
    raw = np.zeros((1 << bits) // 8, np.uint8)
    for r in found.repartition("block").mapInArrow(block, "block bigint, raw binary").toLocalIterator():
        raw[r.block * per // 8 : (r.block + 1) * per // 8] = np.frombuffer(r.raw, np.uint8)
    return Filter(bits, raw)


def _words(first: int, n: int) -> Column:
    """``n`` words of a phrase from the given one, counted from 0."""
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, n), " ")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def mined(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, cover: int = COVER, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``depth`` words."""
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    words = saved(counted(texts, []), "phrases-1")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    kept, filters = [words.filter(F.col("f") >= least)], []
    for d in range(2, depth + 1):
        filters.append(phrase_filter(kept[-1]))
        kept.append(saved(counted(texts, filters).filter(F.col("f") >= least), f"phrases-{d}"))

    def part(d: int, name: str, key: str) -> DataFrame:
        return kept[d - 1].select("lang", F.col("phrase").alias(key), F.col("f").alias(name))

    candidates = []
    for d in range(2, depth + 1):
        rows = kept[d - 1].withColumnRenamed("f", "a")
        best = None
        for k in range(1, d):
            rows = rows.withColumns({"first": _words(0, k), "rest": _words(k, d - k)})
            rows = rows.join(part(k, "l", "first"), ["lang", "first"]).join(part(d - k, "r", "rest"), ["lang", "rest"]).drop("first", "rest")
            up = F.lit(1_000_000).cast("decimal(38,0)") * _exact("a") * _exact("a")
            rows = rows.withColumns({"up": up, "down": _exact("l") * _exact("r")})
            cut = F.struct(F.expr("up div down").alias("score"), F.lit(k).alias("k"), "l", "r")
            best = cut if best is None else F.least(F.col("best"), cut)
            rows = rows.withColumn("best", best).drop("up", "down", "l", "r")
            best = F.col("best")
        rows = rows.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        longer = None
        for e in range(d + 1, depth + 1):
            inner = F.explode(F.array(*(_words(k, d) for k in range(e - d + 1)))).alias("phrase")
            some = kept[e - 1].select("lang", inner, F.col("f").alias("around"))
            longer = some if longer is None else longer.unionByName(some)
        if longer is not None:
            most = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
            rows = rows.join(most, ["lang", "phrase"], "left").filter(f"around IS NULL OR 100 * around < {cover} * a").drop("around")
        candidates.append(rows)
    found = candidates[0]
    for more in candidates[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
