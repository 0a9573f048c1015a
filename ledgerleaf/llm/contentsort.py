"""Exact duplicates by sorting contents.

Texts are normalised (each run of ASCII white space becomes one blank). Sampled splitters
deal the rows into ranges; the split key is the first bytes, a hash and the identifier, so
that splitters stay small and a large group of copies is spread over several ranges. Inside
a range rows are sorted by key, full text and identifier, and every row is compared with
its neighbour in full. A group that reaches over the edge of a range is closed with the
first and last run of every range, two rows for each range.

Null text counts as empty; repeated identifiers are kept and count. Null identifiers sort
last: they stay only if no other row has the text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.memory import settled

#: Bytes of the text in the split key.
HEAD = 24
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text.cast("string"), WHITE, " "), F.lit(""))


FLAGS = ["keep", "size", "first", "edge", "part"]


class _Runs:
    """Cuts the sorted rows of a range into runs.

    ``first_only``: of each run one row leaves, and only that row of the open run is held.
    """

    def __init__(self, part: int, names: list[str], first_only: bool):
        self.part, self.names, self.first_only = part, [*names, *FLAGS], first_only
        self.open: list[list[pa.Array]] = []
        self.size, self.began = 0, False

    def emit(self, columns: list[pa.Array], starts: np.ndarray, sizes: np.ndarray, *, edge: bool) -> pa.RecordBatch:
        first = np.ones(len(starts), bool)
        keep, size = starts, sizes
        if self.first_only:
            columns = [c.take(pa.array(starts)) for c in columns]
            keep = np.arange(len(starts))
        else:
            first = np.zeros(len(columns[0]), bool)
            first[starts] = True
            keep, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        n = len(keep)
        flags = [columns[0].take(pa.array(keep)), pa.array(size, pa.int64()), pa.array(first), pa.array(np.full(n, edge)), pa.array(np.full(n, self.part, np.int32))]
        return pa.RecordBatch.from_arrays([*columns, *flags], names=self.names)

    def hold(self, columns: list[pa.Array]) -> None:
        if not (self.first_only and self.size):
            self.open.append([c.slice(0, 1) for c in columns] if self.first_only else columns)
        self.size += len(columns[0])

    def close(self, *, edge: bool) -> pa.RecordBatch:
        columns = [pa.concat_arrays(list(x)) for x in zip(*self.open)]
        sizes = np.array([self.size])
        self.open, self.size = [], 0
        return self.emit(columns, np.zeros(1, np.int64), sizes, edge=edge)

    def add(self, columns: list[pa.Array], new: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``new``: rows whose text differs from the row before."""
        part = lambda a, b: [c.slice(a, b - a) for c in columns]
        starts = np.flatnonzero(new)
        if len(starts):
            if self.size or starts[0]:
                if starts[0]:
                    self.hold(part(0, int(starts[0])))
                yield self.close(edge=not self.began)
                self.began = True
            if not self.began and len(starts) > 1:
                # The first run of the range is an edge, the others in the batch are not.
                self.hold(part(int(starts[0]), int(starts[1])))
                yield self.close(edge=True)
                self.began, starts = True, starts[1:]
            begin, end = int(starts[0]), int(starts[-1])
            if end > begin:
                yield self.emit(part(begin, end), starts[:-1] - begin, np.diff(starts), edge=False)
            columns = part(end, len(new))
        self.hold(columns)


def _neighbours(names: list[str], first_only: bool):
    """Runs of equal texts in a sorted range; the runs at both ends of the range are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, last = _Runs(TaskContext.get().partitionId(), names, first_only), None
        for b in batches:
            if not b.num_rows:
                continue
            text = b.column(0)
            new = np.ones(b.num_rows, bool)
            new[0] = text[0].as_py() != last
            new[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
            last = text[-1].as_py()
            yield from runs.add(b.columns[1:], new)
        if runs.size:
            yield runs.close(edge=True)

    return run


def _closed(docs: DataFrame, id_column: str, text_column: str, carry: list[str], *, first_only: bool) -> DataFrame:
    """Rows with ``id, text_sha256, keep_id, group_size, kept`` and the carried columns as ``c0, c1, ...``."""
    extra = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_column).alias("id"), normalised(F.col(text_column)).alias("text"), *extra)
    held = [f"c{i}" for i in range(len(carry))]
    keyed = rows.withColumns({"head": F.substring(F.col("text").cast("binary"), 1, HEAD), "hash": F.xxhash64("text")})
    last = F.col("id").asc_nulls_last()
    ranges = keyed.repartitionByRange("head", "hash", last).sortWithinPartitions("head", "hash", "text", last)
    names = ["id", "text_sha256", *held]
    sent = ranges.select("text", "id", F.sha2("text", 256).alias("text_sha256"), *held)
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + f", keep {kinds['id']}, size bigint, first boolean, edge boolean, part int"
    found = settled(sent.mapInArrow(_neighbours(names, first_only), schema), "sorted")
    # Two runs of each range at most, so their number is bounded by twice the number of ranges.
    ends = found.filter("edge AND first").groupBy("text_sha256").agg(
        F.min(F.struct(F.col("keep").isNull().alias("none"), "keep", "part")).alias("best"), F.sum("size").alias("all")
    )
    ends = F.broadcast(ends.select(F.col("text_sha256").alias("digest"), "best", "all"))
    closed = found.join(ends, F.col("edge") & (F.col("text_sha256") == F.col("digest")), "left")
    inside = F.col("best").isNull()
    return closed.select(
        "id",
        "text_sha256",
        F.when(inside, F.col("keep")).otherwise(F.col("best.keep")).alias("keep_id"),
        F.when(inside, F.col("size")).otherwise(F.col("all")).alias("group_size"),
        (F.col("first") & (inside | (F.col("best.part") == F.col("part")))).alias("kept"),
        *held,
    )


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: ``id_column, keep_id, group_size, kept, text_sha256``."""
    return _closed(docs, id_column, text_column, [], first_only=False).withColumnRenamed("id", id_column)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, whole and as they came; of fully repeated rows one stays."""
    closed = _closed(docs, id_column, text_column, docs.columns, first_only=True).filter("kept")
    return closed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
