"""Byte-pair encoding and decoding by a pair occurrence index.

All distinct pieces of a batch are laid out in one symbol array. An index maps every pair
of neighbours that has a merge rank to all its positions. The active ranks are taken in
ascending order; a rank is applied to all its positions at once, and only the lists of the
pairs that touch a merged place are extended. A merge makes a symbol whose own merges have
higher ranks, so one pass over the ranks is exact.

Work is narrow: one pass over the texts, no shuffle, memory bounded by an Arrow batch and
``WORDS`` remembered pieces. Nulls count as empty text; an empty text has no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import pieces
from ledgerleaf.llm.memory import returned

#: Pieces remembered by a task, and symbols indexed at once.
WORDS, SYMBOLS = 300_000, 4_000_000
#: Size of the table of pairs, as a power of two.
SLOT_BITS = 19


@cache
def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and token bytes read from a tokenizer file (path is a parameter)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lowers = bool(spec.get("normalizer"))
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = byte_letters()
        self.plain = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + self.suffix] for x in letters], np.int64)
        size = self.size = max([*vocab.values(), *self.special.values()]) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._hash(left * size + right)
        self.left, self.right, self.made = left, right, made
        byte_of = {x: b for b, x in enumerate(letters)}
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(byte_of[c] for c in token.removesuffix(self.suffix) if c in byte_of)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def _hash(self, pair: np.ndarray) -> None:
        """Open addressing with linear steps, so that ranks are looked up for whole arrays."""
        self.slots, self.slot_rank = np.full(1 << SLOT_BITS, -1), np.full(1 << SLOT_BITS, -1, np.int32)
        rank, slot = np.arange(len(pair)), self._slot(pair)
        while len(rank):
            free = self.slots[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[one]
            self.slots[slot[placed]], self.slot_rank[slot[placed]] = pair[rank[placed]], rank[placed]
            rest = np.ones(len(rank), bool)
            rest[placed] = False
            rank, slot = rank[rest], (slot[rest] + 1) & ((1 << SLOT_BITS) - 1)

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where it has none."""
        key = a * self.size + b
        slot = self._slot(key)
        there = self.slots[slot]
        rank = self.slot_rank[slot]
        rank[there != key] = -1
        step = np.flatnonzero((there != key) & (there >= 0))
        while len(step):
            slot[step] = (slot[step] + 1) & ((1 << SLOT_BITS) - 1)
            there = self.slots[slot[step]]
            hit = there == key[step]
            rank[step[hit]] = self.slot_rank[slot[step[hit]]]
            step = step[~hit & (there >= 0)]
        return rank


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_rank(rank: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(rank, kind="stable")
    rank, at = rank[order], at[order]
    cuts = np.flatnonzero(np.diff(rank)) + 1
    begin = 0
    for end in [*cuts.tolist(), len(rank)]:
        if end > begin:
            yield int(rank[begin]), at[begin:end]
        begin = end


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has. Words are not empty."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbol = v.plain[raw]
    ends = np.cumsum(size)
    symbol[ends - 1] = v.final[raw[ends - 1]]
    n = len(symbol)
    # Next and previous living symbol; n stands for none.
    after = np.arange(1, n + 1)
    after[ends - 1] = n
    before = np.arange(-1, n - 1)
    before[ends - size] = n
    symbol = np.append(symbol, -1)
    after, before = np.append(after, n), np.append(before, n)

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """Puts the pairs that start at these places on the lists of their ranks."""
        at = at[after[at] < n]
        if len(at):
            rank = v.rank_of(symbol[at], symbol[after[at]])
            has = rank >= 0
            for r, places in _by_rank(rank[has], at[has]):
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(places)

    add(np.flatnonzero(after[:n] < n))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = int(v.left[r]), int(v.right[r])
        at = at[symbol[at] == a]
        at = at[symbol[after[at]] == b]
        if a == b and len(at) > 1:
            at = np.unique(at)
            # Of touching pairs every second one merges, from the left.
            new_run = np.append(True, after[at[:-1]] != at[1:])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = v.made[r]
        symbol[gone] = -1
        follow = after[gone]
        after[at] = follow
        has = follow < n
        before[follow[has]] = at[has]
        left = before[at]
        add(np.concatenate([at, left[(left < n) & (symbol[left] != v.made[r])]]))
    living = symbol[:n] >= 0
    counts = np.add.reduceat(living, ends - size) if n else np.zeros(0, np.int64)
    return symbol[:n][living].astype(np.uint32), counts.astype(np.int64)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process; later tasks use the pieces it remembers."""
    return Encoder(path)


class Encoder:
    """Encodes batches of texts; remembers the pieces that it has seen."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, known: int) -> None:
        fresh = [w.encode() for w in list(self.number)[known:]]
        sizes = np.cumsum([0, *map(len, fresh)])
        begin = 0
        while begin < len(fresh):
            end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + SYMBOLS, "right")) - 1)
            flat, size = encode_words(self.v, fresh[begin:end])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
            begin = end

    def _normal(self, text: str) -> str:
        """The word vocabulary's normal form: composed, each letter in lower case by itself."""
        if not self.v.lowers or text.isascii():
            return text.lower() if self.v.lowers else text
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (unsigned 32 bit) of every text; special tokens in a text are taken as such."""
        parts, owner, special = [], [], {}
        for i, text in enumerate(texts):
            text = text or ""
            if self.v.special_at and "<|" in text:
                begin = 0
                for m in self.v.special_at.finditer(text):
                    parts.append(self._normal(text[begin : m.start()]))
                    owner.append(i)
                    special[len(parts) - 1] = self.v.special[m.group()]
                    begin = m.end()
                text = text[begin:]
            parts.append(self._normal(text))
            owner.append(i)
        found = [np.zeros(0, np.uint32)] * len(parts)
        ascii_only = [p.isascii() for p in parts]
        for group in (True, False):
            at = [k for k, x in enumerate(ascii_only) if x == group]
            for k, ids in zip(at, self._ids([parts[k] for k in at])):
                found[k] = ids
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, i in enumerate(owner):
            out[i].append(found[k])
            if k in special:
                out[i].append(np.array([special[k]], np.uint32))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _ids(self, parts: list[str]) -> list[np.ndarray]:
        if not parts:
            return []
        if len(self.number) > WORDS:
            self._forget()
        words, counts = pieces.split(parts, keep_space=not self.v.suffix)
        known = len(self.number)
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > known:
            self._learn(known)
        size = self.size[which]
        to = np.cumsum(size)
        flat = self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.begin[which] - (to - size), size)]
        edges = np.append(0, to)[np.cumsum(np.append(0, counts))].tolist()
        return [flat[a:b] for a, b in zip(edges, edges[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that form no valid character become the replacement character."""
        return b"".join(map(self.v.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def small_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that their bytes stay bounded; a row larger than the bound stands alone."""
    for b in batches:
        rows = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``ids array<int>`` and ``decoded`` of every row.

    Null text counts as empty and has no ids; repeated rows and null identifiers are kept.
    Ids are below 2^31, so the signed array loses nothing.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in small_batches(batches):
            ids = encoder(b.column(1).to_pylist())
            decoded = [encoder.decode(x) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(decoded, pa.string())], names=[id_column, "ids", "decoded"])

    return docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text")).mapInArrow(returned(run), f"`{id_column}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded text; what leaves a task is small."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in small_batches(batches):
            ids = encoder(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text")).mapInArrow(
        returned(run), f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
