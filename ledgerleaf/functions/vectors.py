"""Vector distances, as Spark expressions and for numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2sq", "l2", "cosine", "ip")


def _fold(a: Column, b: Column, f) -> Column:
    terms = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Distance of two arrays of equal size; smaller is nearer."""
    if metric in ("l2sq", "l2"):
        squared = _fold(a, b, lambda x, y: (x - y) * (x - y))
        return squared if metric == "l2sq" else F.sqrt(squared)
    if metric == "ip":
        return 1.0 - dot(a, b)
    if metric == "cosine":
        return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    raise ValueError(f"unknown metric {metric!r}")


def block_distance(query: np.ndarray, block: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query, or of one query per row, to the rows of a block.

    Row by row the same operations in the same order, so equal vectors get equal
    distances whatever block they are in.
    """
    if metric in ("l2sq", "l2"):
        diff = block - query
        squared = np.square(diff).sum(axis=1)
        return squared if metric == "l2sq" else np.sqrt(squared)
    products = (block * query).sum(axis=1)
    if metric == "ip":
        return 1.0 - products
    if metric == "cosine":
        scale = np.sqrt(np.square(block).sum(axis=1) * np.square(query).sum(axis=-1))
        return 1.0 - np.divide(products, scale, out=np.full_like(products, np.nan), where=scale > 0)
    raise ValueError(f"unknown metric {metric!r}")


def distance_bounds(asked: np.ndarray, block: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values that :func:`block_distance` may give, for all pairs by one matrix product.

    ``l2`` is bounded by its square, which has the same order. The span covers the rounding of
    both ways; where a value is not finite, it is unbounded.
    """
    slack = 16 * (block.shape[1] + 8) * np.finfo("float64").eps
    with np.errstate(all="ignore"):
        a, b = np.square(asked).sum(axis=1)[:, None], np.square(block).sum(axis=1)[None, :]
        products = asked @ block.T
        if metric in ("l2sq", "l2"):
            size = a + b
            middle = size - 2 * products
        elif metric == "ip":
            size = 1.0 + np.sqrt(a) * np.sqrt(b)
            middle = 1.0 - products
        elif metric == "cosine":
            scale = np.sqrt(a * b)
            # Beyond this the square of the scale is no normal number.
            scale[scale < 1e-140] = np.nan
            size = np.ones_like(scale)
            middle = 1.0 - products / scale
        else:
            raise ValueError(f"unknown metric {metric!r}")
        error = slack * size + 1e-290
        low, high = middle - error, middle + error
    wild = ~np.isfinite(high)
    if wild.any():
        low[wild], high[wild] = -np.inf, np.inf
    return low, high
