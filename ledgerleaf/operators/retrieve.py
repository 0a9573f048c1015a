"""Scoped nearest-neighbour search over the vector table.

Every request names a workspace and a list of documents; a search over everything
does not exist. Two plans give the same exact result:

* ``block``: for a bounded set of requests. The requests travel to the tasks, each
  task keeps the best ``top_k`` rows per request, and only those are shuffled. The
  vector table is scanned once and never shuffled.
* ``join``: for any number of requests. Rows and requests of a document meet in tiles of
  bounded size, dealt over the tasks by a join of both sides. A matrix product bounds the
  distances of a tile, only rows that may be among the best are scored, and a ranking window
  with a group limit before its shuffle closes the requests over their tiles.

``auto`` measures the requests and takes ``block`` when they fit the bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ledgerleaf import constants as K
from ledgerleaf.functions import text
from ledgerleaf.functions.session import saved
from ledgerleaf.functions.vectors import METRICS, block_distance, distance_bounds
from ledgerleaf.operators.store import bucket_of

MAX_BLOCK_REQUESTS = 4096
MAX_BLOCK_SCOPES = 200_000
MAX_BLOCK_FLOATS = 8_000_000
MAX_PRUNED_VALUES = 1000
#: Rows and requests of a tile, and numbers of a matrix or of scored vectors held at a time.
TILE_ROWS = 4096
TILE_FLOATS = 4_000_000


def request_error(
    dimensions: int = K.DEFAULT_DIMENSIONS, max_top_k: int = K.MAX_TOP_K, check_vector: bool = True
) -> Column:
    """Why a search request is refused, or null; the first reason counts."""
    scope = F.coalesce(F.col("selected_document_ids"), F.array().cast("array<string>"))
    error = F.when(text.is_blank(F.col("workspace_id")), "missing_workspace_id")
    error = error.when(F.size(scope) == 0, "missing_scope")
    error = error.when(F.exists(scope, text.is_blank), "blank_document_id")
    if check_vector:
        size = F.coalesce(F.size("query_embedding"), F.lit(0))
        error = error.when(size <= 0, "missing_vector").when(size != dimensions, "dimension_mismatch")
    top_k = F.coalesce(F.col("top_k"), F.lit(K.DEFAULT_TOP_K))
    return error.when(top_k <= 0, "top_k_too_small").when(top_k > max_top_k, "top_k_too_large")


def _cleaned(requests: DataFrame) -> DataFrame:
    return requests.select(
        "query_id",
        text.strip(F.col("workspace_id")).alias("workspace_id"),
        F.array_distinct(F.transform("selected_document_ids", text.strip)).alias("scope"),
        "query_embedding",
        F.coalesce(F.col("top_k").cast("int"), F.lit(K.DEFAULT_TOP_K)).alias("top_k"),
    )


def scope_rows(requests: DataFrame) -> DataFrame:
    """One row per request and document in its scope, without duplicates."""
    return _cleaned(requests).select("query_id", "workspace_id", F.explode("scope").alias("document_id"))


def in_scope(vectors: DataFrame, requests: DataFrame) -> DataFrame:
    """Vector rows, or rows per document, paired with the requests whose scope holds their document."""
    return vectors.join(scope_rows(requests), ["workspace_id", "document_id"])


def _fits_block(requests: DataFrame) -> bool:
    size = requests.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.size("scope")), F.lit(0)).alias("scopes"),
        F.coalesce(F.sum(F.size("query_embedding")), F.lit(0)).alias("floats"),
    ).first()
    return (
        size["n"] <= MAX_BLOCK_REQUESTS
        and size["scopes"] <= MAX_BLOCK_SCOPES
        and size["floats"] <= MAX_BLOCK_FLOATS
    )


@dataclass(frozen=True)
class _Request:
    query_id: object
    vector: np.ndarray
    top_k: int
    scopes: frozenset[int]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best(found: Found, k: int) -> Found:
    """The k nearest of (distances, record ids, scopes), ties by record id; distances that are no number come last."""
    dist, rec, scope = found
    far = np.where(np.isnan(dist), np.inf, dist)
    if len(dist) > k:
        near = far <= np.partition(far, k - 1)[k - 1]
        dist, rec, scope, far = dist[near], rec[near], scope[near], far[near]
    order = np.lexsort((scope, rec, np.isnan(dist), far))[:k]
    return dist[order], rec[order], scope[order]


def _block_scorer(requests: list[_Request], metric: str, schema: pa.Schema):
    by_scope = defaultdict(list)
    for i, r in enumerate(requests):
        for s in r.scopes:
            by_scope[s].append(i)

    def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                yield batch.filter(pa.array(sizes == n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Found] = {}
        for batch in by_size(batches):
            scope = batch.column("scope_no").to_numpy(zero_copy_only=False)
            vector = batch.column("vector")
            flat = vector.flatten().to_numpy(zero_copy_only=False)
            block = flat.reshape(batch.num_rows, -1).astype("float64")
            record = np.asarray(batch.column("record_id").to_pylist(), dtype=object)
            order = np.argsort(scope, kind="stable")
            present, starts = np.unique(scope[order], return_index=True)
            rows_of = dict(zip(present.tolist(), np.split(order, starts[1:])))
            wanted = {i for s in rows_of for i in by_scope[s] if len(requests[i].vector) == block.shape[1]}
            for i in wanted:
                r = requests[i]
                rows = np.concatenate([rows_of[s] for s in r.scopes if s in rows_of])
                dist = block_distance(r.vector, block[rows], metric)
                seen = best.get(i)
                if seen is not None:
                    dist = np.concatenate([seen[0], dist])
                    names = np.concatenate([seen[1], record[rows]])
                    where = np.concatenate([seen[2], scope[rows]])
                else:
                    names, where = record[rows], scope[rows]
                best[i] = _best((dist, names, where), r.top_k)
        for i, (dist, names, where) in best.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i] * len(dist), type=pa.int32()),
                    pa.array(where, type=pa.int32()),
                    pa.array(names.tolist(), type=pa.string()),
                    pa.array(dist, type=pa.float64()),
                ],
                schema=schema,
            )

    return score


def _ranked(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "record_id", "document_id")
    # The literal bound lets the planner put a group limit before the shuffle.
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter((F.col("rank") <= K.MAX_TOP_K) & (F.col("rank") <= F.col("top_k")))
        .drop("top_k")
    )


def _block_plan(
    vectors: DataFrame, requests: DataFrame, metric: str, buckets: int | None
) -> tuple[DataFrame, DataFrame]:
    spark = vectors.sparkSession
    rows = requests.collect()  # measured before: see _fits_block
    numbers: dict[tuple[str, str], int] = {}
    held = []
    for r in rows:
        scopes = {numbers.setdefault((r["workspace_id"], d), len(numbers)) for d in r["scope"]}
        held.append(
            _Request(r["query_id"], np.asarray(r["query_embedding"], "float64"), r["top_k"], frozenset(scopes))
        )
    scope = spark.createDataFrame(
        [(w, d, n) for (w, d), n in numbers.items()],
        "workspace_id string, document_id string, scope_no int",
    )
    pruned = vectors
    workspaces = sorted({w for w, _ in numbers})
    if len(workspaces) <= MAX_PRUNED_VALUES:
        pruned = pruned.filter(F.col("workspace_id").isin(workspaces))
    if buckets is not None and "bucket" in vectors.columns:
        touched = scope.select(bucket_of(F.col("document_id"), buckets).alias("b")).distinct()
        names = [r["b"] for r in touched.collect()]  # at most `buckets` values
        pruned = pruned.filter(F.col("bucket").isin(names))
    if held:
        pruned = pruned.filter(F.size("vector").isin(sorted({len(r.vector) for r in held})))

    schema = pa.schema([("query_no", pa.int32()), ("scope_no", pa.int32()), ("record_id", pa.string()), ("distance", pa.float64())])
    found = (
        pruned.select("workspace_id", "document_id", "record_id", "vector")
        .join(F.broadcast(scope), ["workspace_id", "document_id"])  # at most MAX_BLOCK_SCOPES rows
        .select("scope_no", "record_id", "vector")
        .mapInArrow(_block_scorer(held, metric, schema), "query_no int, scope_no int, record_id string, distance double")
    )
    id_type = requests.schema["query_id"].dataType.simpleString()
    names = spark.createDataFrame(
        [(i, r.query_id, r.top_k) for i, r in enumerate(held)], f"query_no int, query_id {id_type}, top_k int"
    )
    named = found.join(F.broadcast(names), "query_no").join(F.broadcast(scope), "scope_no")
    ranked = _ranked(named.drop("query_no", "scope_no"))
    # At most MAX_BLOCK_REQUESTS * MAX_TOP_K rows, so the table is not shuffled to fetch the payload.
    return pruned, F.broadcast(ranked)


def _few_of_equal(rows: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that ``most`` equal vectors precede; no request can want them."""
    if rows.shape[1] == 0 or len(rows) <= most:
        return np.arange(len(rows))
    packed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, first, group = np.unique(packed, return_index=True, return_inverse=True)
    if len(first) == len(rows):
        return np.arange(len(rows))
    by = np.lexsort((order, group))
    starts = np.searchsorted(group[by], np.arange(len(first)))
    return np.sort(by[np.arange(len(by)) - starts[group[by]] < most])


def nearest_in_tile(
    rows: np.ndarray, record: np.ndarray, asked: np.ndarray, keep: np.ndarray, metric: str,
    cell: np.ndarray | None = None, probes: np.ndarray | None = None,
) -> Found:
    """The ``keep`` nearest rows of each request: (request, row, distance), ties by record id.

    Exact: all rows whose least possible distance is within the k-th greatest possible one are
    scored by :func:`block_distance`. With ``cell`` of the rows and ``probes``, a matrix of
    requests by cells, a request sees the rows of its cells only.
    """
    order = np.empty(len(record), "int64")
    order[np.argsort(record, kind="stable")] = np.arange(len(record))
    if cell is None:
        used = _few_of_equal(rows, order, int(keep.max()))
        rows, order = rows[used], order[used]
    else:
        used = np.argsort(cell, kind="stable")
        rows, order, cell = rows[used], order[used], cell[used]
        cells, begins = np.unique(cell, return_index=True)
        spans = list(zip(cells.tolist(), begins.tolist(), [*begins[1:].tolist(), len(cell)]))
    out = []
    step = max(1, TILE_FLOATS // len(rows))
    for at in range(0, len(asked), step):
        part, k = asked[at : at + step], keep[at : at + step]
        if cell is None:
            low, high = distance_bounds(part, rows, metric)
            seen = None
        else:
            low, high = np.full((2, len(part), len(rows)), np.inf)
            seen = np.zeros(low.shape, bool)
            for c, begin, end in spans:
                who = np.flatnonzero(probes[at : at + step, c])
                if len(who):
                    low[who, begin:end], high[who, begin:end] = distance_bounds(part[who], rows[begin:end], metric)
                    seen[who, begin:end] = True
        top = min(int(k.max()), len(rows))
        least = np.sort(np.partition(high, top - 1, axis=1)[:, :top], axis=1)
        limit = np.where(k > top, np.inf, least[np.arange(len(part)), np.minimum(k, top) - 1])
        near = low <= limit[:, None]
        if seen is not None:
            near &= seen
        who, row = np.nonzero(near)
        dist = np.empty(len(who))
        pairs = max(1, TILE_FLOATS // max(1, rows.shape[1]))
        for i in range(0, len(who), pairs):
            now = slice(i, i + pairs)
            dist[now] = block_distance(part[who[now]], rows[row[now]], metric)
        far = np.where(np.isnan(dist), np.inf, dist)
        by = np.lexsort((order[row], np.isnan(dist), far, who))
        starts = np.searchsorted(who[by], np.arange(len(part)))
        by = by[np.arange(len(by)) - starts[who[by]] < k[who[by]]]
        out.append((who[by] + at, used[row[by]], dist[by]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tile_scorer(metric: str, cells: int | None, schema: pa.Schema):
    def by_scope(table: pa.Table) -> dict[tuple, list[int]]:
        found = defaultdict(list)
        for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("workspace_id", "document_id", "size")))):
            found[key].append(i)
        return found

    def matrix(table: pa.Table, name: str, n: int) -> np.ndarray:
        flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.astype("float64").reshape(table.num_rows, n)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, parts = by_scope(right), []
        for key, at in by_scope(left).items():
            if key not in wanted:
                continue
            rows, asked = left.take(at), right.take(wanted[key])
            inside = ()
            if cells is not None:
                probes = np.zeros((asked.num_rows, cells), bool)
                for i, near in enumerate(asked.column("probes").to_pylist()):
                    probes[i, near] = True
                inside = (rows.column("cell").to_numpy(), probes)
            who, row, dist = nearest_in_tile(
                matrix(rows, "vector", key[2]), np.asarray(rows.column("record_id").to_pylist(), dtype=object),
                matrix(asked, "query_embedding", key[2]), asked.column("keep").to_numpy(), metric, *inside,
            )
            held = {**{c: asked.column(c).take(who) for c in ("query_id", "top_k")}, **{c: rows.column(c).take(row) for c in ("workspace_id", "document_id", "record_id")}}
            parts.append(pa.table({**held, "distance": dist}).select(schema.names).cast(schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return score


def scored_in_tiles(vectors: DataFrame, requests: DataFrame, metric: str, cells: int | None = None) -> DataFrame:
    """The nearest rows of every cleaned request in each tile of rows of its documents; ``top_k`` rows at least.

    A tile holds about ``TILE_ROWS`` rows and as many requests of one document, or of many
    small ones; a large document has several, and each of its rows meets each of its requests
    in one of them. With ``cells`` the rows bring their ``cell`` and the requests their ``probes``.
    """
    keys = ["workspace_id", "document_id", "size"]
    # Requests that share an identifier are ranked together.
    most = F.least(F.max("top_k").over(Window.partitionBy("query_id")), F.lit(K.MAX_TOP_K))
    inside = ([], []) if cells is None else (["cell"], ["probes"])
    wanted = requests.withColumn("keep", most).filter("keep > 0").select(
        "query_id", "workspace_id", F.explode("scope").alias("document_id"), "query_embedding", "top_k", "keep",
        F.size("query_embedding").alias("size"), *inside[1],
    )
    rows = vectors.select("workspace_id", "document_id", "record_id", "vector", F.size("vector").alias("size"), *inside[0])
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((rows, "n_rows"), (wanted, "n_asked"))]
    scopes = counts[0].join(counts[1], keys).withColumns(
        {"row_tiles": F.ceil(F.col("n_rows") / TILE_ROWS), "asked_tiles": F.ceil(F.col("n_asked") / TILE_ROWS)}
    )
    scopes = saved(scopes.withColumn("small", F.expr("row_tiles = 1 AND asked_tiles = 1")), "scopes")
    held = scopes.filter("small").agg(F.sum("n_rows").alias("r"), F.sum("n_asked").alias("q")).first()
    tiles = max(1, -(-max(held["r"] or 0, held["q"] or 0) // TILE_ROWS))
    place = F.xxhash64(*keys)
    scopes = scopes.select(*keys, "row_tiles", "asked_tiles", F.when(F.col("small"), F.pmod(place, F.lit(tiles))).otherwise(place).alias("place"))

    def dealt(df: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        placed = df.join(scopes, keys).withColumn(own, F.pmod(F.xxhash64(*by), F.col(f"{own}_tiles")))
        met = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_tiles") - 1)))
        # Both sides come from one table; named anew, their columns can be told apart.
        return met.select(*df.columns, *(F.col(c).alias(c) for c in ("place", "row", "asked")))

    left = dealt(rows, "row", "asked", "record_id", "vector").groupBy("place", "row", "asked")
    right = dealt(wanted, "asked", "row", "query_id", "query_embedding").groupBy("place", "row", "asked")
    id_type = requests.schema["query_id"].dataType.simpleString()
    found = T.StructType.fromDDL(f"query_id {id_type}, workspace_id string, document_id string, record_id string, top_k int, distance double")
    return left.cogroup(right).applyInArrow(_tile_scorer(metric, cells, to_arrow_schema(found)), found)


def _join_plan(vectors: DataFrame, requests: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    return vectors, _ranked(scored_in_tiles(vectors, requests, metric))


def top_k(
    vectors: DataFrame,
    requests: DataFrame,
    *,
    metric: str = "l2sq",
    plan: str = "auto",
    buckets: int | None = None,
) -> DataFrame:
    """Nearest stored rows of every request, inside its workspace and documents.

    ``requests``: query_id, workspace_id, selected_document_ids, query_embedding,
    top_k (at most 50). Returns the stored columns plus query_id, rank and
    distance; ties are broken by record id. ``buckets`` is the bucket count of a
    table written by ``store.upsert`` and prunes its partitions.
    """
    if metric not in METRICS or plan not in ("auto", "block", "join"):
        raise ValueError(f"unknown metric {metric!r} or plan {plan!r}")
    cleaned = _cleaned(requests)
    if plan == "auto":
        plan = "block" if _fits_block(cleaned) else "join"
    elif plan == "block" and not _fits_block(cleaned):
        raise ValueError("too many requests for the block plan")
    if plan == "block":
        source, ranked = _block_plan(vectors, cleaned, metric, buckets)
    else:
        source, ranked = _join_plan(vectors, cleaned, metric)
    return with_payload(source, ranked)


def with_payload(source: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranked rows with their stored columns.

    A record id alone is ambiguous: its parts may hold the mark that joins them.
    """
    payload = source.select(
        "record_id", "workspace_id", "document_id", "chunk_id", "chunk_index", "document_type",
        F.coalesce("text_content", F.lit("")).alias("text_content"),
    )
    return payload.join(ranked, ["workspace_id", "document_id", "record_id"]).select("query_id", "rank", "distance", *payload.columns)


def totals(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Hit count of every request, including those without a hit."""
    counted = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return requests.select("query_id").join(counted, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("total_results")
    )


def hit_error(scope: Column, workspace_id: Column) -> Column:
    """Why a returned row is unsafe to use, or null."""
    names = ("chunk_id", "document_id", "workspace_id", "document_type")
    missing = F.col("chunk_index").isNull()
    blank = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
        blank = blank | (text.strip(F.col(n)) == "")
    return (
        F.when(missing, "missing_metadata")
        .when(blank, "invalid_metadata")
        .when(F.expr("try_cast(chunk_index as int)").isNull(), "invalid_chunk_index")
        .when(text.strip(F.col("workspace_id")) != workspace_id, "outside_workspace")
        .when(~F.array_contains(scope, text.strip(F.col("document_id"))), "outside_scope")
    )


def check_hits(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: number of hits, unsafe hits and the error of the first unsafe one.

    One unsafe hit fails the whole request.
    """
    asked = _cleaned(requests).select(
        "query_id", F.col("workspace_id").alias("asked_workspace"), F.col("scope").alias("asked_scope")
    )
    checked = hits.join(asked, "query_id").withColumn(
        "error", hit_error(F.col("asked_scope"), F.col("asked_workspace"))
    )
    return checked.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.count("error").alias("unsafe_hits"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("rank"))).alias("error"),
    )
