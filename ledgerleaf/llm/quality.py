"""Quality of documents by the subword classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import labelled, subword

#: Documents at or above this score stay.
KEEP = 0.3


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", parts: int = 5, part: int = 0):
    out = labelled.held_out(id_column, parts, part)
    share = labels.filter(~out & F.col(label).isNotNull()).agg(F.avg(label)).first()[0]
    rows = labelled.sample(docs, labels, label, out, subword.TRAIN_ROWS, id_column)
    return subword.fit(rows, share)


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, held_out, score, predicted`` of every row."""
    model = fit(docs, labels, id_column=id_column)
    rows = subword.score(docs.select(F.col(id_column), F.col(text_column).alias("text")), model)
    return rows.select(id_column, labelled.held_out(id_column, 5, 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that are not rejected, with their own columns."""
    name = "_".join(["score", *docs.columns])  # no column has this name
    return subword.score(docs, fit(docs, labels, id_column=id_column), text_column, name).filter(F.col(f"`{name}`") >= KEEP).drop(name)
