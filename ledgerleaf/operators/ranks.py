"""Exact percentiles of groups of any size, by refined sketches.

Each pass narrows, for every group and fraction, the span of values that holds the wanted
rank. A mergeable sketch of the values inside the span proposes two bounds around the rank,
and an exact count of the values below, between and above says on which side the rank lies.
A pass divides the rows of a span by about ``ACCURACY / 4``, so two or three passes do for
any table; the state of a group is one row for each fraction. No group is sorted or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.session import saved

#: Entries of a sketch: its size in memory, not the accuracy of the result.
ACCURACY = 2_000


def percentiles(df: DataFrame, group: str, value: str, fractions: list[float]) -> DataFrame:
    """``group, fraction, result``: the smallest value with at least that fraction of the rows at or below it.

    Null values don't count; a group of nulls has no row. NaN is the largest value.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v IS NOT NULL")
    wanted = F.explode(F.array(*map(F.lit, fractions))).alias("fraction")
    spans = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rank = F.greatest(F.ceil(F.col("fraction") * F.col("n")), F.lit(1)).alias("rank")
    spans = saved(spans.select("*", wanted).select("g", "fraction", rank, "low", "high", "n"), "spans")
    while not spans.filter("low <> high").isEmpty():
        spans = saved(_narrowed(rows, spans), "spans")
    return spans.select(F.col("g").alias(group), "fraction", F.col("low").alias("result"))


def _narrowed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rank`` is counted within the span, which holds ``n`` rows."""
    key = ["g", "fraction"]
    # Spans are one row for each group and fraction: the planner sends them to the rows.
    same = F.col("s.g").eqNullSafe(F.col("r.g")) & F.col("r.v").between(F.col("s.low"), F.col("s.high"))
    open_ = spans.filter("low <> high")
    inside = rows.alias("r").join(open_.alias("s"), same).select("s.*", "r.v")
    # The sketch answers a fixed grid; the two grid points around the rank are picked afterwards.
    grid = [i / 200 for i in range(201)]
    sketch = inside.groupBy(F.col("g").alias("of"), F.col("fraction").alias("at")).agg(F.percentile_approx("v", grid, ACCURACY).alias("grid"))
    at = F.floor((F.col("rank") - 1) / F.col("n") * 200).cast("int")
    picked = open_.join(sketch, F.col("g").eqNullSafe(F.col("of")) & (F.col("fraction") == F.col("at"))).select(
        *open_.columns,
        F.element_at("grid", F.greatest(at, F.lit(1))).alias("a"),
        F.element_at("grid", F.least(at + 3, F.lit(201))).alias("b"),
    )
    held = rows.alias("r").join(picked.alias("s"), same).select("s.*", "r.v")
    v, a, b, rank = F.col("v"), F.col("a"), F.col("b"), F.col("rank")
    between = (v > a) & (v < b)
    counted = held.groupBy(*picked.columns).agg(
        F.count_if(v < a).alias("below"),
        F.count_if(v <= a).alias("to_a"),
        F.count_if(v < b).alias("to_b"),
        F.count_if(v <= b).alias("upto"),
        F.max(F.when(v < a, v)).alias("under"),
        F.min(F.when(between, v)).alias("first"),
        F.max(F.when(between, v)).alias("last"),
        F.min(F.when(v > b, v)).alias("over"),
    )

    def by_side(left, at_a, inside, at_b, right):
        """Every case ends the search or leaves both bounds out, so each pass gets on."""
        return F.when(rank <= F.col("below"), left).when(rank <= F.col("to_a"), at_a).when(rank <= F.col("to_b"), inside).when(rank <= F.col("upto"), at_b).otherwise(right)

    next_ = counted.select(
        *key,
        by_side(rank, rank, rank - F.col("to_a"), rank, rank - F.col("upto")).alias("rank"),
        by_side(F.col("low"), a, F.col("first"), b, F.col("over")).alias("low"),
        by_side(F.col("under"), a, F.col("last"), b, F.col("high")).alias("high"),
        by_side(F.col("below"), F.col("n"), F.col("to_b") - F.col("to_a"), F.col("n"), F.col("n") - F.col("upto")).alias("n"),
    )
    return spans.filter("low = high").unionByName(next_)
