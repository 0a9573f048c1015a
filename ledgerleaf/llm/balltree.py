"""Exact top-k by inner product: branch and bound in a ball tree for each shard.

Components are turned into integers, so scores are exact. Every input partition builds
ball trees over at most ``SHARD`` rows. Queries form blocks; a cell of the search joins one
block with a bounded number of shards by key. In a cell the shards and their nodes are taken
in the order of their upper bound ``q.c + |q| r``, and the current k-th score of each query
is shared by all of them: a node whose bound can't reach it is left out for that query. What
leaves a cell is k rows for each query; a window ranks them.

Rows with a null identifier or a vector that is null or holds null or non-finite components
take no part; vectors meet those of equal length only. Repeated candidate rows all count; a
query identifier that is repeated is asked once, with the smallest of its vectors. Ties go
to the smaller identifier. Scores wrap at 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tree, rows of a leaf, queries of a block, shards of a cell.
SHARD, LEAF, BLOCK, CELL = 8_192, 64, 1_024, 6
NONE = np.iinfo(np.int64).min


def _usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd)


def _by_length(b: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Identifiers and integer vectors of a batch, for each length of vectors."""
    ids, lists = b.column(0).to_numpy(), b.column(1)
    size = lists.value_lengths().to_numpy()
    flat = np.floor(scale * lists.flatten().to_numpy())
    begin = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield n, ids[at], flat[begin[at][:, None] + np.arange(n)].astype(np.int64)


class Tree:
    """Nodes over a permutation of the rows; leaves are ordered by identifier."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.arange(len(ids))
        real = rows.astype(np.float64)
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left, right
        centers, radii, least = [], [], []

        def make(begin: int, end: int) -> int:
            at = order[begin:end]
            part = real[at]
            center = part.mean(axis=0)
            far = np.sqrt(((part - center) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append((begin, end, -1, -1))
            centers.append(center)
            radii.append(far.max(initial=0.0))
            least.append(ids[at].min())
            if end - begin > LEAF and radii[me] > 0:
                one = part[far.argmax()]
                two = part[((part - one) ** 2).sum(axis=1).argmax()]
                along = part @ (two - one)
                half = (end - begin) // 2
                order[begin:end] = at[np.argpartition(along, half)]
                left = make(begin, begin + half)
                self.nodes[me] = (begin, end, left, make(begin + half, end))
            else:
                order[begin:end] = at[np.argsort(ids[at], kind="stable")]
            return me

        make(0, len(ids))
        self.ids, self.rows = ids[order], rows[order]
        self.centers, self.radii, self.least = np.array(centers), np.array(radii), np.array(least)

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.ids, self.rows, np.array(self.nodes, np.int64), self.centers, self.radii, self.least)]

    @classmethod
    def unpack(cls, n: int, parts: list[bytes]) -> Tree:
        t = cls.__new__(cls)
        t.ids, t.least = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[5], np.int64)
        t.rows = np.frombuffer(parts[1], np.int64).reshape(len(t.ids), n)
        t.nodes = np.frombuffer(parts[2], np.int64).reshape(-1, 4)
        t.centers, t.radii = np.frombuffer(parts[3], np.float64).reshape(len(t.nodes), n), np.frombuffer(parts[4], np.float64)
        return t


class Best:
    """The k best rows of every query of a block so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.real = ids, rows, rows.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(axis=1))
        self.top = np.abs(self.real).max(initial=0.0)
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def bound(self, tree: Tree, node: int, ask: np.ndarray) -> np.ndarray:
        """Upper bounds of the queries' scores in a node, with room for rounding."""
        center = tree.centers[node]
        reach = self.norm[ask] * tree.radii[node]
        return self.real[ask] @ center + reach + 1e-9 * (reach + self.norm[ask] * np.sqrt(center @ center)) + 1e-6

    def open(self, tree: Tree, node: int, ask: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Queries whose k-th hit a row of the node may still replace."""
        kth, last = self.score[ask, -1], self.found[ask, -1]
        up = np.floor(bound)
        return (up > kth) | ((up >= kth) & (tree.least[node] < last))

    def read(self, tree: Tree, begin: int, end: int, ask: np.ndarray) -> None:
        """Scores the rows of a leaf, in blocks, against the queries."""
        for a in range(begin, end, 4 * LEAF):
            ids, rows = tree.ids[a : min(end, a + 4 * LEAF)], tree.rows[a : min(end, a + 4 * LEAF)]
            wide = self.top * np.abs(rows.astype(np.float64)).max(initial=0.0) * max(rows.shape[1], 1)
            score = (self.real[ask] @ rows.T.astype(np.float64)).astype(np.int64) if wide < 2**52 else self.rows[ask] @ rows.T
            better = (score > self.score[ask, -1][:, None]) | ((score == self.score[ask, -1][:, None]) & (ids < self.found[ask, -1][:, None]))
            better &= ids != self.ids[ask][:, None]
            for i in np.flatnonzero(better.any(axis=1)).tolist():
                q, at = ask[i], np.flatnonzero(better[i])
                s, d = np.concatenate([self.score[q], score[i, at]]), np.concatenate([self.found[q], ids[at]])
                keep = np.lexsort((d, ~s))[: self.score.shape[1]]
                self.score[q], self.found[q] = s[keep], d[keep]

    def search(self, trees: list[Tree]) -> None:
        """Nodes of all shards in the order of their largest bound."""
        ask = np.arange(len(self.ids))
        heap = []
        for t, tree in enumerate(trees):
            heapq.heappush(heap, (-float(self.bound(tree, 0, ask).max(initial=-np.inf)), t, 0, ask))
        while heap:
            _, t, node, ask = heapq.heappop(heap)
            tree = trees[t]
            ask = ask[self.open(tree, node, ask, self.bound(tree, node, ask))]
            if not len(ask):
                continue
            begin, end, left, right = map(int, tree.nodes[node])
            if left < 0:
                self.read(tree, begin, end, ask)
                continue
            for child in (left, right):
                bound = self.bound(tree, child, ask)
                still = ask[self.open(tree, child, ask, bound)]
                if len(still):
                    heapq.heappush(heap, (-float(bound.max()), t, child, still))


PARTS = ["ids", "rows", "nodes", "centers", "radii", "least"]


def _build(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 24

        def flush(n: int) -> pa.RecordBatch:
            nonlocal number
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(n)))
            number += 1
            packed = Tree(ids, rows).pack()
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x]) for x in packed)], names=["n", "shard", *PARTS])

        for b in batches:
            for k in range(0, b.num_rows, SHARD):
                for n, ids, rows in _by_length(b.slice(k, SHARD), scale):
                    if sum(len(x) for x, _ in held.get(n, ())) + len(ids) > SHARD:
                        yield flush(n)
                    held.setdefault(n, []).append((ids, rows))
        for n in list(held):
            yield flush(n)

    return run


def _pack(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for n, ids, rows in _by_length(b, scale):
                held.setdefault(n, []).append((ids, rows))
        for n, found in held.items():
            ids, rows = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ids.tobytes()]), pa.array([rows.tobytes()])],
                names=["n", "block", "ask", "asked"],
            )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, id_column, score``: the k rows of highest integer inner product for each query."""
    rows = _usable(vectors, id_column, vector_column)
    asked = _usable(queries, id_column, vector_column).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    groups = max(1, -(-vectors.count() // (SHARD * CELL)))
    tree_schema = "n int, shard bigint, " + ", ".join(f"{c} binary" for c in PARTS)
    shards = rows.mapInArrow(_build(scale), tree_schema)
    shards = shards.withColumns({"cell": F.pmod(F.xxhash64("shard"), F.lit(groups)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    packed = asked.repartition(blocks, F.xxhash64("id", F.lit("block"))).mapInArrow(_pack(scale), "n int, block int, ask binary, asked binary")
    packed = packed.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        trees = [Tree.unpack(r["n"], [r[c] for c in PARTS]) for r in right.select(["n", *PARTS]).to_pylist()]
        out = []
        for r in left.to_pylist() if trees else []:
            best = Best(np.frombuffer(r["ask"], np.int64), np.frombuffer(r["asked"], np.int64).reshape(-1, r["n"]) if r["n"] else np.zeros((len(r["ask"]) // 8, 0), np.int64), k)
            best.search(trees)
            real = best.found != np.iinfo(np.int64).max
            out.append((np.repeat(best.ids, k)[real.ravel()], best.found[real], best.score[real]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    keys = ["n", "block", "cell"]
    found = packed.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInArrow(cell, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
