"""Connected components of a table of links, by alternating stars.

Each round points every vertex at the smallest neighbour it knows, first among its larger
neighbours, then among its smaller ones, until every vertex points at the smallest of its
component. Rounds are written to the shared folder, so the lineage stays short. Minima are
combined before the shuffle; a vertex with very many links only makes one side of a join
long, which the planner can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.session import saved


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``vertex, root`` of every vertex that has a link and isn't its own root; links are ``a, b``."""
    turned = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = saved(turned.distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        pairs = large.join(least, F.col("a") == F.col("k"))
        small = pairs.select("a", F.col("m").alias("b")).unionByName(pairs.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = saved(small.distinct(), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
