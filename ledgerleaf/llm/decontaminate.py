"""Benchmark passages in training texts, by a generalised suffix automaton over words.

The words of all test items go into one automaton, whose states stand for sets of word
sequences that occur in the items. A text is read word by word; state and longest matching
length are carried along, so every position knows the longest passage of the items that
ends there. Where that length reaches ``window`` words, the last ``window`` words are a
window of some item; items with fewer words are a window as a whole and are found on the
suffix links. Only stretches of neighbouring words that occur side by side in some item are
walked at all.

Items are cut into parts of at most ``PART`` words that overlap by ``window - 1`` words, so
each window lies in one part, and the parts are dealt into shards of about ``SHARD`` bytes.
Each shard's automaton is built in a task and broadcast for one narrow pass over the texts;
with several shards the passes follow one another. Broadcasts are bounded by the shard, no
text is shuffled, and memory is bounded by a batch and one automaton.

Null and empty texts have no words. Items without words have no windows. An item with a null
identifier marks words but is not listed; equal identifiers count once. Repeated rows and
null identifiers of documents are kept. Without items nothing is hit.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.session import saved
from ledgerleaf.llm.bpe import small_batches

#: Words of a window.
WINDOW = 10
#: Words of a part of an item, bytes of items in one automaton, bytes of text read at once.
PART, SHARD, TEXT = 20_000, 1 << 20, 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.full: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        self.shortest = window

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """State of the passages of ``q`` that end a longest passage of ``p`` and the word."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return self._split(last, word, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def add(self, words: list[bytes]) -> None:
        state = 0
        for w in words:
            state = self._extend(state, self.vocabulary.setdefault(w, len(self.vocabulary)))

    def _anchor(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of the passages of ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def mark(self, item: str | None, words: list[bytes]) -> None:
        """Notes the windows of a sequence that :meth:`add` has taken."""
        state = 0
        for n, w in enumerate(words, 1):
            state = self.next[state][self.vocabulary[w]]
            if n >= self.window:
                state = self._anchor(state, self.window)
                self.full.setdefault(state, set()).add(item)
        if 0 < len(words) < self.window:
            size = len(words)
            self.short.setdefault(self._anchor(state, size), {}).setdefault(size, set()).add(item)
            self.shortest = min(self.shortest, size)

    def close(self) -> None:
        """Prepares matching: one table of moves, nearest marks on the suffix links, pairs of neighbours."""
        size = self.size = max(len(self.vocabulary), 1)
        self.moves = {s * size + w: t for s, moves in enumerate(self.next) for w, t in moves.items()}
        self.marked = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.short else self.marked[self.link[s]]
        self.pairs = np.array(sorted({a * size + b for a, s in self.next[0].items() for b in self.next[s]}), np.int64)
        del self.next

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, raw: bytes) -> Automaton:
        made = cls.__new__(cls)
        vars(made).update(pickle.loads(raw))
        return made

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of known words, long enough for a window, whose neighbours all occur side by side in items."""
        joined = np.zeros(len(ids) + 1, bool)
        if self.shortest > 1 and len(self.pairs):
            at = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0))
            key = ids[at] * self.size + ids[at + 1]
            near = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[at[self.pairs[near] == key] + 1] = True
            edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
        else:
            edge = np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= self.shortest
        return zip(begin[long].tolist(), end[long].tolist())

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """First place, place behind, and items of every window that occurs; -1 stands for an unknown word."""
        moves, link, length, size, window = self.moves, self.link, self.length, self.size, self.window
        for begin, end in self._stretches(ids):
            state = matched = 0
            for p, w in enumerate(ids[begin:end].tolist(), begin):
                to = moves.get(state * size + w)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = moves.get(state * size + w)
                if to is None:
                    continue
                state, matched = to, matched + 1
                if matched >= window:
                    yield p + 1 - window, p + 1, self.full[self._anchor(state, window)]
                u = self.marked[state]
                while u > 0:
                    for n, items in self.short[u].items():
                        if n <= matched:
                            yield p + 1 - n, p + 1, items
                    u = self.marked[link[u]]


def automaton(rows: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Automaton:
    made = Automaton(window)
    for _, words in rows:
        made.add(words)
    for item, words in rows:
        made.mark(item, words)
    made.close()
    return made


def _parts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                starts = range(0, max(len(words) - window + 1, 1), PART - window + 1) if words else []
                texts = [b" ".join(words[k : k + PART]).decode() for k in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(starts, pa.int64())], names=["item", "words", "start"]
                )

    return run


def automata(items: DataFrame, window: int, id_column: str, text_column: str) -> Iterator[bytes]:
    """The automaton of each shard, pickled, one after another."""
    texts = items.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text"))
    parts = saved(texts.mapInArrow(_parts(window), "item string, words string, start bigint"), "items")
    size = parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0

    def build(rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows.column("item").to_pylist(), (w.encode().split(b" ") for w in rows.column("words").to_pylist())), key=lambda r: (r[0] or "", r[1]))
        return pa.table({"automaton": pa.array([automaton(parts, window).packed()], pa.binary())})

    shard = F.pmod(F.xxhash64("item", "start"), F.lit(1 + size // SHARD)).alias("shard")
    built = parts.select("item", "words", shard).groupBy("shard").applyInArrow(build, "automaton binary")
    return (bytes(r.automaton) for r in built.toLocalIterator())


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _match(shared, text: int, kinds: dict[str, pa.DataType]):
    """Adds what one automaton finds to what the passes before have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Automaton.unpacked(shared.value)
        get = made.vocabulary.get
        for b in small_batches(batches, TEXT):
            if not b.num_rows:
                continue
            split = [words_of(t) for t in b.column(text).to_pylist()]
            count = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.full(int(count.sum()) + len(split), -1, np.int64)  # one unknown word behind each text
            begin = np.cumsum(count + 1) - count - 1
            for k, words in zip(begin.tolist(), split):
                ids[k : k + len(words)] = [get(w, -1) for w in words]
            runs, items = b.column(len(kinds) - 2).to_pylist(), b.column(len(kinds) - 1).to_pylist()
            new: dict[int, tuple[list, set]] = {}
            for a, z, who in made.hits(ids):
                row = int(np.searchsorted(begin, a, "right")) - 1
                at, names = new.setdefault(row, ([], set()))
                at.append((a - int(begin[row]), z - int(begin[row])))
                names |= who
            for row, (at, names) in new.items():
                at += [(r["first"], r["behind"]) for r in runs[row]]
                runs[row] = [{"first": a, "behind": z} for a, z in _joined(at)]
                items[row] = sorted({*items[row], *names} - {None})
            made_columns = [pa.array(count), pa.array(runs, kinds["runs"]), pa.array(items, kinds["items"])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kinds) - 3], *made_columns], names=list(kinds))

    return run


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))


def found(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Columns of ``docs`` in struct ``doc``, and ``n_words``, ``runs`` (first word, word behind), ``items`` of every row."""
    held = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index(text_column)
    columns = [(F.col(f"`{c}`").cast("string") if i == text else F.col(f"`{c}`")).alias(held[i]) for i, c in enumerate(docs.columns)]
    empty = "array<struct<first: bigint, behind: bigint>>"
    rows = docs.select(*columns, F.lit(0).cast("bigint").alias("n_words"), F.array().cast(empty).alias("runs"), F.array().cast("array<string>").alias("items"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    kinds = dict.fromkeys(rows.columns) | {"runs": _RUNS, "items": pa.list_(pa.string())}
    context, passes = docs.sparkSession.sparkContext, 0
    # An automaton has at most two states and three moves for each word of its shard.
    for made in automata(items, window, id_column, text_column):
        rows = (saved(rows, "matched") if passes else rows).mapInArrow(_match(context.broadcast(made), text, kinds), schema)
        passes += 1
    if not passes:
        rows = rows.mapInArrow(_match(context.broadcast(automaton([], window).packed()), text, kinds), schema)
    whole = F.struct(*(F.col(h).alias(c) for h, c in zip(held, docs.columns))).alias("doc")
    return rows.select(whole, "n_words", "runs", "items")


def hit_words(runs: str = "runs"):
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["behind"] - r["first"])


def summary(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_column: str = "doc_id", id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``doc_column, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    rows = found(docs.select(doc_column, text_column), items, window, id_column, text_column)
    return rows.select(
        F.col("doc")[doc_column].alias(doc_column),
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def removed(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int = WINDOW, share: float = 0.5, id_column: str = "item_id", text_column: str = "text"
) -> DataFrame:
    """The rows without the spans of at least ``span`` words; rows of which more than ``share`` of the words is hit go.

    A span reaches from its first to its last word; what stands around it stays. Other columns come as they are.
    """
    rows = found(docs, items, window, id_column, text_column).filter(hit_words() <= share * F.greatest("n_words", F.lit(1)))
    long = F.filter("runs", lambda r: r["behind"] - r["first"] >= span)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if runs:
                    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
                    ends = [0, *(x for r in runs for x in (places[r["first"]][0], places[r["behind"] - 1][1])), len(text)]
                    text = "".join(text[a:z] for a, z in zip(ends[::2], ends[1::2]))
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc", "text"])

    kind = rows.schema["doc"].dataType.simpleString()
    cleaned = rows.select("doc", F.col("doc")[text_column].alias("text"), long.alias("runs")).mapInArrow(cut, f"doc {kind}, text string")
    return cleaned.select(*(F.col("text").alias(c) if c == text_column else F.col("doc")[c].alias(c) for c in docs.columns))


_LOWER = {c: c + 32 for c in range(65, 91)}
