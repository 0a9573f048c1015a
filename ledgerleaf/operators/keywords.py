"""Rule tables of any length: one automaton over all their words, applied inside the tasks.

A text is read once, however many rules there are. The failure links of the automaton
report every word that ends at a character, so overlapping words and words inside words
are all found. Rules that share their common words form a class, which is scored as one and
remembered by the common words of a document. So a word of many rules costs its classes, and
one by one only rules are scored that a rare word of the document names.

Rules are sorted by Spark and stay an Arrow table everywhere; what a task derives from them are
numbers in arrays. A Python object for each rule and word, and classes remembered by their number
rather than their size, took more than a gigabyte of a worker.

The rules travel to the tasks as a broadcast of measured size. A longer table is cut into
slices by hash; the slices follow one another, the best rule so far is written between them.
Documents are never shuffled.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf.functions.session import saved

RULE_BYTES = 32 << 20  # of rules in the tasks at once
RULE_COST = 64  # bytes of a rule besides its words
WORD_LISTS = ("primary", "secondary", "headers", "negative")
RULE_COLUMNS = ("rule_no", "doc_type", *WORD_LISTS)
PACKED = pa.schema([("rule_no", pa.int64()), ("doc_type", pa.string()), *((name, pa.list_(pa.string())) for name in WORD_LISTS)])
BEST = "struct<points:int,order:bigint,document_type:string,primary:array<string>,secondary:array<string>,headers:array<string>>"
VETO = -(1 << 40)  # no sum of points reaches it
LAST = -(1 << 63)  # the order of a rule without a number
COMMON = 64  # rules of a word beyond which it is common
REMEMBERED = 8 << 20  # bytes of classes in order that a task keeps, by sets of common words
AT_ONCE = 4096  # words that are Python objects while an automaton is filled

Best = tuple[int, int, str | None, list[str], list[str], list[str]]


def _in_order(rules: Iterable[Sequence]) -> pa.Table:
    """Rules as a packed table in evaluation order."""
    listed = [(r[0], r[1], *(tuple(w for w in words or () if w is not None) for words in r[2:])) for r in rules]
    listed.sort(key=lambda r: (r[1] is not None, r[1] or "", *r[2:]), reverse=True)
    listed.sort(key=lambda r: (r[0] is None, r[0] or 0))
    return pa.table([[r[n] for r in listed] for n in range(len(PACKED))], schema=PACKED)


class Words:
    """Points that the words of one kind of text give to rules; a word is a slot.

    ``lists`` are word lists of all rules and the points that their words give. The votes of a slot
    stand together in ``rules`` and ``points``, from ``starts[slot]`` on. A word listed twice by a
    rule counts twice.
    """

    def __init__(self, lists: Sequence[tuple[pa.ListArray, int]]):
        sizes = [np.diff(words.offsets.to_numpy()) for words, _ in lists]
        coded = pa.concat_arrays([words.flatten() for words, _ in lists]).dictionary_encode()
        slots = coded.indices.to_numpy()
        order = np.argsort(slots, kind="stable")
        self.rules = np.concatenate([np.repeat(np.arange(len(n), dtype="int32"), n) for n in sizes])[order]
        self.points = np.repeat([points for _, points in lists], [n.sum() for n in sizes])[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=len(coded.dictionary)))])
        self.everywhere: set[int] = set()  # the empty word is in every text
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at in range(0, len(coded.dictionary), AT_ONCE):
            for slot, word in enumerate(coded.dictionary.slice(at, AT_ONCE).to_pylist(), at):
                if word:
                    self.automaton.add_word(word, slot)
                else:
                    self.everywhere.add(slot)
        if len(self.automaton):
            self.automaton.make_automaton()

    def common(self) -> np.ndarray:
        """Slots of the words that many rules have."""
        return np.flatnonzero(np.diff(self.starts) > COMMON)

    def votes(self, slot: int) -> Iterator[tuple[int, int]]:
        """Rules of a word, and the points that it gives them."""
        here = slice(self.starts[slot], self.starts[slot + 1])
        return zip(self.rules[here].tolist(), self.points[here].tolist())

    def found(self, text: str | None) -> set[int]:
        """The distinct words of a text."""
        slots = set(self.everywhere)
        if text and len(self.automaton):
            slots.update(slot for _, slot in self.automaton.iter(text))
        return slots


class Matcher:
    """The best rule of a document among a list of rules.

    Rules stand in evaluation order: smaller ``rule_no`` first, rules without a number last,
    repeated numbers by the larger type and words. A packed table is taken as it stands.
    """

    def __init__(self, rules: pa.Table | Iterable[Sequence]):
        table = rules if isinstance(rules, pa.Table) else _in_order(rules)
        self.columns = {name: pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], PACKED.field(name).type) for name in RULE_COLUMNS}
        primary, secondary, headers, negative = (self.columns[name] for name in WORD_LISTS)
        self.corpus = Words([(primary, K.PRIMARY_POINTS), (secondary, K.SECONDARY_POINTS), (negative, VETO)])
        self.headers = Words([(headers, K.HEADER_POINTS)])
        self._group(len(table))
        self._remembered: OrderedDict[frozenset, tuple] = OrderedDict()
        self._held = 0

    def _group(self, n_rules: int) -> None:
        """Classes of rules with the same common words, numbered by their first members."""
        sides = [(side, words, words.common()) for side, words in enumerate((self.corpus, self.headers))]
        #: Classes and points of each common word.
        self.worth: dict[tuple[int, int], np.ndarray] = {(side, slot): np.empty((0, 2), "int64") for side, _, common in sides for slot in common.tolist()}
        at = [words.starts[slot] + np.arange(words.starts[slot + 1] - words.starts[slot]) for _, words, common in sides for slot in common]
        sizes = np.array([len(a) for a in at], dtype="int64")
        per_side = np.cumsum([0, *(len(common) for _, _, common in sides)])
        joined = [np.concatenate(at[per_side[side] : per_side[side + 1]] or [np.empty(0, "int64")]) for side, _, _ in sides]
        rule = np.concatenate([words.rules[a] for (_, words, _), a in zip(sides, joined)])
        points = np.concatenate([words.points[a] for (_, words, _), a in zip(sides, joined)])
        word = np.repeat(np.arange(len(sizes)), sizes)
        kinds, kind = np.unique(points, return_inverse=True)
        vote = word * max(len(kinds), 1) + kind
        order = np.lexsort((vote, rule))
        rule, vote, word, points = rule[order], vote[order], word[order], points[order]

        length = np.bincount(rule, minlength=n_rules)
        start = np.cumsum(length) - length
        number, n = np.full(n_rules, -1, dtype="int64"), 0
        for size in np.unique(length[length > 0]).tolist():
            here = np.flatnonzero(length == size)
            alike = np.unique(vote[start[here][:, None] + np.arange(size)], axis=0, return_inverse=True)[1].ravel()
            number[here] = n + alike
            n += int(alike.max()) + 1
        #: Members of the classes in evaluation order, those of a class from ``first[class]`` on.
        self.members = np.flatnonzero(number >= 0).astype("int32")
        leaders = self.members[np.unique(number[self.members], return_index=True)[1]] if n else self.members
        renamed = np.empty(n, dtype="int32")
        renamed[np.argsort(leaders)] = np.arange(n, dtype="int32")
        #: Class of each rule, -1 without a common word.
        self.class_of = np.full(n_rules, -1, dtype="int32")
        self.class_of[self.members] = renamed[number[self.members]]
        self.members = self.members[np.argsort(self.class_of[self.members], kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.class_of[self.members], minlength=n))])

        leaders = np.sort(leaders)  # in the order of the classes
        size = length[leaders]
        taken = np.repeat(start[leaders] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        classes = np.repeat(np.arange(n), size)
        by_word = np.argsort(word[taken], kind="stable")
        gives = np.stack([classes, points[taken]], axis=1)[by_word]
        ends = np.cumsum(np.bincount(word[taken], minlength=len(sizes)))
        for key, end, begin in zip(self.worth, ends, [0, *ends]):
            self.worth[key] = gives[begin:end]

    def classes(self, common: frozenset[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes that the words name and their points; those above zero, best first, and their points."""
        if common in self._remembered:
            self._remembered.move_to_end(common)
            return self._remembered[common]
        votes = np.concatenate([self.worth[word] for word in common] or [np.empty((0, 2), "int64")])
        numbers, at = np.unique(votes[:, 0], return_inverse=True)
        sums = np.zeros(len(numbers), dtype="int64")
        np.add.at(sums, at, votes[:, 1])
        scored = np.flatnonzero(sums > 0)
        capped = np.minimum(sums[scored], K.MAX_POINTS)
        order = np.argsort(-capped, kind="stable")
        out = numbers.astype("int32"), sums, numbers[scored[order]].astype("int32"), capped[order].astype("int32")
        cost = lambda key, arrays: 512 + 128 * len(key) + sum(a.nbytes for a in arrays)
        self._remembered[common] = out
        self._held += cost(common, out)
        while self._held > REMEMBERED:
            self._held -= cost(*self._remembered.popitem(last=False))
        return out

    def best(self, corpus: str | None, headers: str | None) -> Best:
        """Points and words of the best rule; no points and no words where none scores."""
        named: dict[int, int] = defaultdict(int)
        common = []
        for side, (words, text) in enumerate(((self.corpus, corpus), (self.headers, headers))):
            for slot in words.found(text):
                if (side, slot) in self.worth:
                    common.append((side, slot))
                else:
                    for rule, points in words.votes(slot):
                        named[rule] += points
        numbers, sums, ranked, worth = self.classes(frozenset(common))
        top = (0, 0)  # least of (-points, rule)
        for rule, points in named.items():
            number = self.class_of[rule]
            at = np.searchsorted(numbers, number) if number >= 0 else len(numbers)
            if at < len(numbers) and numbers[at] == number:
                points += int(sums[at])
            if points > 0:
                top = min(top, (-min(points, K.MAX_POINTS), rule))
        for number, points in zip(ranked, worth):
            members = self.members[self.first[number] : self.first[number + 1]]
            if (-int(points), int(members[0])) > top:
                break
            # Those that a rare word names have been scored with it.
            rule = next((int(r) for r in members if int(r) not in named), None)
            if rule is not None:
                top = min(top, (-int(points), rule))
        if top[0] < 0:
            number, doc_type, primary, secondary, heads = (self.columns[name][top[1]].as_py() for name in RULE_COLUMNS[:5])
            return -top[0], LAST if number is None else -number, doc_type, primary, secondary, heads
        return 0, LAST, None, [], [], []


_held: list = []


def _matcher(rules: bytes) -> Matcher:
    """The matcher of a broadcast; a Python worker makes it once for the tasks that follow one another in it."""
    if not _held or _held[0] is not rules:
        _held[:] = []
        _held[:] = [rules, Matcher(pa.ipc.open_stream(rules).read_all())]
    return _held[1]


def _packed(rules: DataFrame) -> bytes:
    """Rules in evaluation order, sorted by Spark, as an Arrow stream."""
    words = [F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda w: w.isNotNull()).alias(c) for c in WORD_LISTS]
    table = (
        rules.select("rule_no", "doc_type", *words)
        .orderBy(F.col("rule_no").asc_nulls_last(), F.col("doc_type").desc_nulls_last(), *(F.col(c).desc() for c in WORD_LISTS))
        .toArrow()
        .cast(PACKED)
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACKED) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _best(rules: DataFrame, corpus: Column, headers: Column) -> Column:
    """Best rule of a slice that was measured to fit into a broadcast."""
    packed = rules.sparkSession.sparkContext.broadcast(_packed(rules))

    @F.pandas_udf(BEST)
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(packed.value)
        names = ["points", "order", "document_type", "primary", "secondary", "headers"]
        for texts, heads in batches:
            yield pd.DataFrame([matcher.best(*pair) for pair in zip(texts, heads, strict=True)], columns=names)

    # Marked so that a filter on the result does not run it a second time.
    return best.asNondeterministic()(corpus, headers)


def with_best_rule(df: DataFrame, rules: DataFrame, corpus: str, headers: str, to: str, at_once: int = RULE_BYTES) -> DataFrame:
    """Add the best rule of every row as a struct ``to``; narrow, one pass for each slice.

    ``rules`` has ``rule_no, doc_type, primary, secondary, headers, negative``. Null words and
    null lists say nothing, an empty word is in every text, equal rows are one rule, null texts
    hold no words. An empty rule table is refused.
    """
    rules = rules.select(F.col("rule_no").cast("bigint"), *RULE_COLUMNS[1:]).distinct()
    words = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in WORD_LISTS))
    cost = F.octet_length(F.array_join(words, " ")) + F.coalesce(F.octet_length("doc_type"), F.lit(0)) + RULE_COST
    total = rules.agg(F.sum(cost.cast("bigint"))).first()[0]
    if total is None:
        raise ValueError("the rule list is empty")
    slices = -(-total // at_once)
    if slices > 1:
        rules = saved(rules, "rules")
    for n in range(slices):
        part = rules.filter(F.pmod(F.xxhash64(*RULE_COLUMNS), F.lit(slices)) == n) if slices > 1 else rules
        here = _best(part, F.col(corpus), F.col(headers))
        if n == 0:
            df = df.withColumn(to, here)
        else:
            df = saved(df, "best-rule").withColumn(to, F.greatest(F.col(to), here))
    return df
