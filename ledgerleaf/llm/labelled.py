"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(column: str, parts: int, part: int):
    """Whether a row is kept away from learning: CRC-32 of its identifier as text, by remainder."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts == part


def sample(docs: DataFrame, labels: DataFrame, label: str, out, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``text, label`` of at most ``most`` labelled identifiers of each class, held-out ones left out.

    Rows are picked by the hash of their identifier, so any run takes the same ones. Labels
    that are null or name no document are passed over; of several labels the largest counts.
    The picked identifiers are at most ``2 * most`` rows, so they are broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~out)
    one = known.groupBy(F.col(id_column).alias("known_id")).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("known_id", F.lit("sample"))
    picked = [one.filter(F.col("label") == y).orderBy(order, "known_id").limit(most) for y in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_column).alias("known_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return texts.join(few, "known_id").select("text", "label")


def weights(labels: DataFrame, label: str, out, most: int, id_column: str = "doc_id") -> dict[int, float]:
    """How many labelled identifiers a row of :func:`sample` stands for, by class; 1 for a class that is taken whole."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~out)
    one = known.groupBy(id_column).agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in one.filter("label IN (0, 1)").groupBy("label").count().collect()}
    return {y: n / min(n, most) for y, n in counts.items()}
