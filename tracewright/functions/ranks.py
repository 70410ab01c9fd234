"""Gapless numbers over a total order, without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored


def ordinals(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name = 0, 1, 2 ... in the order of the columns (a total order). Rows are range-
    partitioned and numbered inside their partition, and written once so; a partition's offset, a number
    each, is added where they are read."""
    part = f"_{name}_part"
    # numbered as they lie, partition by partition: a window would exchange the whole rows once more
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.monotonically_increasing_id())
    ranged = stored(placed.withColumn(name, F.col(part).bitwiseAND((1 << 33) - 1)).withColumn(part, F.shiftright(part, 33).cast("int")))
    counts = dict(ranged.groupBy(part).agg(F.count("*").alias("_n")).collect())  # a row per partition
    offsets = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    return ranged.withColumn(name, F.col(name) + F.get(F.lit(np.array(offsets, np.int64)), F.col(part))).drop(part)


def positions(df: DataFrame, key: list[str], pos: str, name: str, span: int = 65536) -> DataFrame:
    """df with name = 0, 1, 2 ... inside each key in the order of the integer column pos (unique in
    a key). A key is numbered span by span and the spans' counts are added up, so a key with very
    many rows is the work of many tasks."""
    block = f"_{name}_span"
    rows = df.withColumn(block, F.floor(F.col(pos) / span).cast("long"))
    counts = rows.groupBy(*key, block).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*key, block, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, block).orderBy(pos)
    rows = rows.withColumn(name, F.row_number().over(inside) - 1).join(offsets, [*key, block])
    return rows.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop(block, "_before")
