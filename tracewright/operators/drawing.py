"""What a drawing of the flow graph needs, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import label


def _labelled(rows: DataFrame) -> DataFrame:
    ends = rows.select("var_ord", label(F.col("src_type"), F.col("src_kind"), F.col("src")).alias("src_label"), label(F.col("dst_type"), F.col("dst_kind"), F.col("dst")).alias("dst_label"))
    return ends.withColumn("var_name", F.concat(F.lit("e"), F.col("var_ord").cast("string")))


def edge_list(rows: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(a, b, var_name, colour): one undirected line for each pair of labels; of several sources
    that share labels the last one counts. Chosen variables are 'r', others 'g'."""
    ends = _labelled(rows)
    if chosen is not None:
        ends = ends.join(chosen.select("var_ord", F.lit("r").alias("hit")), "var_ord", "left")
    else:
        ends = ends.withColumn("hit", F.lit(None).cast("string"))
    pair = ends.select(F.least("src_label", "dst_label").alias("a"), F.greatest("src_label", "dst_label").alias("b"), "var_ord", "var_name", F.coalesce("hit", F.lit("g")).alias("colour"))
    return pair.groupBy("a", "b").agg(F.max_by("var_name", "var_ord").alias("var_name"), F.max_by("colour", "var_ord").alias("colour"))


def scenes(rows: DataFrame) -> DataFrame:
    """(var_name, src_label, dst_label): each variable's line in a hypergraph scene."""
    return _labelled(rows).select("var_name", "src_label", "dst_label")
