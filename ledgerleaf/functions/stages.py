"""Stage boundaries inside one plan, and the log of a run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import session


def counted(df: DataFrame, stage: str, **counts: Column) -> DataFrame:
    """Observe the row count (and further counts) of a stage while it runs.

    The observation is also a boundary for the optimizer: filters on computed columns
    stay above it. Without it a filter such as ``is_valid`` is pushed down through all
    projections, and the whole computation of the column is copied into the filter and
    run twice. Columns are still pruned through it. Filter on input columns *before*
    a stage, so that they reach the scan.
    """
    extra = [F.count_if(c).alias(name) for name, c in counts.items()]
    return df.observe(f"{stage}-{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"), *extra)


class RunLog:
    """What the written steps of a run took and held, as an audit table.

    A step is what one write computes: stages that share a narrow plan can't be timed apart.
    Counts are observed by the tasks while the step is written, so nothing is read twice; they
    are those of the attempt that succeeded. A step over an empty table counts zero, and a step
    that fails leaves no row.
    """

    SCHEMA = "step string, started_at timestamp, ms double, counter string, value bigint"

    def __init__(self) -> None:
        self._rows: list[tuple] = []

    def timed(self, step: str, run: Callable[[], object], counts: Callable[[], dict[str, int]] = dict) -> object:
        """Run a step; ``counts`` gives its counters afterwards. Without any, the step has one row without a counter."""
        started, clock = datetime.now(timezone.utc), time.monotonic()
        out = run()
        ms = (time.monotonic() - clock) * 1000
        self._rows += [(step, started, ms, name, value) for name, value in (counts() or {None: None}).items()]
        return out

    def saved(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        """Write a table once, read it back, and log its rows and how many of them hold each condition."""
        seen = Observation()
        counters = [F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(name) for name, c in counts.items())]
        return self.timed(step, lambda: session.saved(df.observe(seen, *counters), step), lambda: seen.get)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._rows, self.SCHEMA)
