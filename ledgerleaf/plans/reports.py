"""Batch summaries over processed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.operators import ranks


def type_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("document_type").agg(
        F.count("*").alias("documents"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


def issue_report(issues: DataFrame) -> DataFrame:
    return issues.groupBy("document_type", "rule_id", "severity").agg(F.count("*").alias("issues"))


def latency_summary(audit: DataFrame) -> DataFrame:
    """Count, mean and exact percentiles per stage of ``audit(stage, ms)``; no stage is sorted in one task."""
    plain = audit.groupBy("stage").agg(F.count("*").alias("runs"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))
    found = ranks.percentiles(audit, "stage", "ms", [0.5, 0.95]).groupBy(F.col("stage").alias("of")).agg(
        *(F.max(F.when(F.col("fraction") == p, F.col("result"))).alias(name) for p, name in ((0.5, "p50_ms"), (0.95, "p95_ms")))
    )
    return plain.join(found, F.col("stage").eqNullSafe(F.col("of")), "left").drop("of")


def foreign_rows(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Hits whose workspace is not the one of their request; must be empty."""
    asked = requests.select("query_id", F.trim("workspace_id").alias("asked_workspace"))
    return hits.join(asked, "query_id").filter(F.col("workspace_id") != F.col("asked_workspace"))
