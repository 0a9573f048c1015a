"""Approximate scoped search: cells of a k-means partition in front of exact scoring.

Cells are learned once from a bounded sample and stored with the rows. A request probes the
cells nearest to its vector; it meets the rows of its documents in tiles, in which only rows
of those cells are looked at, exactly. Their share is about ``probes / cells``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.operators.retrieve import _cleaned, _ranked, scored_in_tiles, with_payload

#: Rows at most that the cells are learned from.
SAMPLE_ROWS = 20_000
CELLS, PROBES = 32, 18


def fit_cells(vectors: DataFrame, dimensions: int, cells: int = CELLS, seed: int = 17) -> np.ndarray:
    """Centres of the cells, from at most ``SAMPLE_ROWS`` rows picked by hash."""
    usable = vectors.filter(F.size("vector") == dimensions).select("record_id", F.col("vector").cast("array<double>").alias("vector"))
    sample = usable.filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x))).orderBy(F.xxhash64("record_id"), "record_id").limit(SAMPLE_ROWS)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(sample.select(array_to_vector("vector").alias("features")))
    return np.array(model.clusterCenters())


def nearest_cells(vector: Column, centres: np.ndarray, n: int) -> Column:
    """The ``n`` cells whose centres are nearest; null for vectors of another size."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        at = [i for i, v in enumerate(vectors) if v is not None]
        if at:
            block = np.stack([np.asarray(vectors.iloc[i], "float64") for i in at])
            far = (centres**2).sum(axis=1) - 2 * block @ centres.T
            for i, order in zip(at, np.argsort(far, axis=1, kind="stable")[:, :n]):
                out[i] = order.astype("int32")
        return pd.Series(out, dtype=object)

    return cells(F.when(F.size(vector) == centres.shape[1], vector))


def with_cell(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Store the cell beside the vector, so that a search does not compute it again."""
    usable = vectors.filter(F.size("vector") == centres.shape[1])
    return usable.withColumn("cell", F.get(nearest_cells(F.col("vector"), centres, 1), F.lit(0)))


def approx_top_k(celled: DataFrame, requests: DataFrame, centres: np.ndarray, *, probes: int = PROBES, metric: str = "l2sq") -> DataFrame:
    """Approximate form of :func:`retrieve.top_k` over rows from :func:`with_cell`."""
    asked = _cleaned(requests).filter(F.size("query_embedding") == centres.shape[1])
    asked = asked.withColumn("probes", nearest_cells(F.col("query_embedding"), centres, probes))
    scored = scored_in_tiles(celled, asked, metric, cells=len(centres))
    return with_payload(celled, _ranked(scored))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per request."""
    kept = approximate.select("query_id", "record_id", F.lit(1).alias("found"))
    return (
        exact.select("query_id", "record_id")
        .join(kept, ["query_id", "record_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("hits"), F.count("found").alias("found"))
        .withColumn("recall", F.col("found") / F.col("hits"))
    )
