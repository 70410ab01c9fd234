"""The document store's reads and writes as DataFrame operations.

Stores are immutable here: a write takes the old rows and gives the new ones, and a table is
replaced as a whole. "Last" means the greatest value of a sequence column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find(df: DataFrame, where: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """Rows that equal all of where, with the named fields; both reach the file scan."""
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == F.lit(value))
    return df.select(*fields) if fields else df


def find_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the first row in the given total order."""
    one = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(one)).where("_rank = 1").drop("_rank")


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def upsert(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: the last written. The values are combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_last"))
    return last.select(*keys, "_last.*")


def push(rows: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """For each key the list of its values in order, repeats kept."""
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_l"))
    return lists.select(*keys, F.col("_l.v").alias(name))


def set_field(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def truncate(df: DataFrame) -> DataFrame:
    """The table's schema without rows."""
    return df.limit(0)


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
