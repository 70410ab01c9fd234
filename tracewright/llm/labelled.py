"""The bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_ids(labels: DataFrame, max_rows: int, label: str = "quality") -> DataFrame:
    """(doc_id, y) of at most max_rows labelled documents, a documented bound: those with the
    smallest hash of their id, so the choice is fixed and spread evenly. Rows that are held out
    (crc32 of the id mod 3 is 1), null ids and null labels are no part of it; an id with several
    labels takes their rounded mean."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    one = rows.groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, y): one row for each sampled id that docs has; of several texts the least.
    The sampled ids are at most max_rows and so are broadcast."""
    ids = F.broadcast(labelled_ids(labels, max_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(ids, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
