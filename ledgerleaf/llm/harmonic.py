"""Harmonic packing of token sequences into bins of a fixed capacity.

Class ``j`` takes pieces of a length in ``(C/(j+1), C/j]``; a bin of that class holds exactly
``j`` pieces. A document is cut so that its pieces come close to the top of their class:
whole bins first, then the largest ``C/j`` that fits, until the rest wastes at most
``SLACK`` tokens in its class. Above ``FINE`` pieces a bin the classes get coarser, so that
few bins stay open.

Every task fills bins by itself. Only the pieces of bins that a task couldn't fill go on:
they are dealt anew over ever fewer tasks until they are few, and the last ones are put
into bins first-fit by length. What one task reads is bounded by ``LAST`` and ``SHARE``.

Null text counts as empty: such a document has one token, the end mark. Repeated rows and
null identifiers are kept; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.session import saved
from ledgerleaf.llm.bpe import encoder_of, small_batches
from ledgerleaf.llm.memory import returned

#: Tokens that a piece may waste in its class before it is cut once more.
SLACK = 12
#: Up to so many pieces a bin every count is a class of its own.
FINE = 16
#: Open pieces that one task may place at the end, and that one task takes in the rounds before.
LAST, SHARE = 10_000, 100_000


def counts_of(capacity: int) -> list[int]:
    """Pieces a bin of each class, ascending."""
    counts, j = [], 1
    while j <= capacity:
        counts.append(j)
        j = j + 1 if j < FINE else j + j // 8
    return counts


def cut(length: int, capacity: int, counts: list[int]) -> list[tuple[int, int]]:
    """Lengths of a document's pieces in order, each with its class (pieces a bin)."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = int(np.searchsorted(counts, capacity // rest, "right")) - 1  # most pieces that are sure to fit
        j = counts[k]
        if capacity // j - rest <= SLACK or k + 1 == len(counts):
            out.append((rest, j))
            break
        full = capacity // counts[k + 1]
        out.append((full, counts[k + 1]))
        rest -= full
    return out


class Filler:
    """Open bins of one task: a bin leaves when it has its count."""

    def __init__(self, first: int):
        self.open: dict[int, list] = defaultdict(list)
        self.next = first

    def put(self, piece: tuple, j: int) -> list[tuple]:
        bin_ = self.open[j]
        bin_.append(piece)
        if len(bin_) < j:
            return []
        self.open[j] = []
        at, out = 0, []
        for p in bin_:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        return [(*p, None, None) for bin_ in self.open.values() for p in bin_]


COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bin_count int, sequence_id bigint, offset bigint"


def _rows(kind: pa.DataType, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece: ``id_column, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {COLUMNS}"
    names = [id_column, *(c.split()[0] for c in COLUMNS.split(", "))]
    counts = counts_of(capacity)
    end = np.array([end_id], "<u4")

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        fill, id_type = Filler(TaskContext.get().partitionId() << 32), None
        for b in small_batches(batches):
            id_type = b.column(0).type
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder(b.column(1).to_pylist())):
                raw = memoryview(np.concatenate([ids.astype("<u4"), end]).tobytes())
                total, start = len(raw) // 4, 0
                for length, j in cut(total, capacity, counts):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    out += fill.put((doc, start, length, crc, total, j), j)
                    start += length
            yield _rows(id_type, names, out)
        if id_type is not None:
            yield _rows(id_type, names, fill.rest())

    def again(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fill, id_type = Filler((level << 58) + (TaskContext.get().partitionId() << 32)), None
            for b in batches:
                id_type = b.column(0).type
                out = []
                for row in zip(*(c.to_pylist() for c in b.columns[:6])):
                    out += fill.put(row, row[5])
                yield _rows(id_type, names, out)
            if id_type is not None:
                yield _rows(id_type, names, fill.rest())

        return run

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, id_type = [], None
        for b in batches:
            id_type = b.column(0).type
            rows += zip(*(c.to_pylist() for c in b.columns[:6]))
        if id_type is None:
            return
        rows.sort(key=lambda r: -r[2])
        free: list[int] = []
        out, begin = [], 0
        for row in rows:
            while begin < len(free) and free[begin] == 0:
                begin += 1
            k = next((k for k in range(begin, len(free)) if free[k] >= row[2]), len(free))
            if k == len(free):
                free.append(capacity)
            out.append((*row, (1 << 62) + k, capacity - free[k]))
            free[k] -= row[2]
        yield _rows(id_type, names, out)

    texts = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    level, depth = saved(texts.mapInArrow(returned(first_level), schema), "packed-1"), 1
    done, left = level.filter("sequence_id IS NOT NULL"), level.filter("sequence_id IS NULL")
    parts = 0
    while parts != 1 and (pieces := left.count()) > LAST:
        depth, parts = depth + 1, max(1, min(pieces // SHARE, parts // 2 if parts else pieces))
        dealt = left.repartition(parts, F.xxhash64(id_column, "start")) if parts > 1 else left.coalesce(1)
        level = saved(dealt.mapInArrow(returned(again(depth)), schema), f"packed-{depth}")
        done, left = done.unionByName(level.filter("sequence_id IS NOT NULL")), level.filter("sequence_id IS NULL")
    placed = left.coalesce(1).mapInArrow(last, schema)
    return done.unionByName(placed).drop("bin_count")
