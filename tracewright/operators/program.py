"""The selection program: a 0/1 variable for each source of each hyperedge, linear constraints at
nodes, one unit into the sink models, and a weight to maximise.

position says which variable of an edge a node's outgoing sum takes: "exact" the node's own, "first"
always the edge's first one (as the program was first written).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AND, MODEL, OR

NODE = ["node_id", "node_type"]


def variables(rows: DataFrame) -> DataFrame:
    """(var_name, var_ord, edge_ord, pos, dst, dst_type, edge_type, src, src_type, weight)."""
    return rows.select(F.concat(F.lit("e"), F.col("var_ord").cast("string")).alias("var_name"), "var_ord", "edge_ord", "pos", "dst", "dst_type", "edge_type", "src", "src_type", "weight")


def incoming(rows: DataFrame) -> DataFrame:
    """(node_id, node_type, var_ord, bt): the variables of the first edge into each node."""
    keyed = rows.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), "edge_ord", "edge_type", "var_ord")
    first = keyed.groupBy(*NODE).agg(F.min("edge_ord").alias("edge_ord"))
    return keyed.join(first, [*NODE, "edge_ord"]).select(*NODE, "var_ord", F.col("edge_type").alias("bt"))


def outgoing(rows: DataFrame, position: str = "exact") -> DataFrame:
    """(node_id, node_type, edge_ord, edge_type, var_ord): one variable for each edge that has the
    node as a source."""
    if position not in ("exact", "first"):
        raise ValueError("position is 'exact' or 'first'")
    # one value of a group, so that all readers ask for the same exchange
    own = F.min_by(F.struct("var_ord", "edge_type"), "pos").alias("own")
    found = rows.groupBy(F.col("src").alias("node_id"), F.col("src_type").alias("node_type"), "edge_ord").agg(own).select(*NODE, "edge_ord", "own.edge_type", "own.var_ord")
    if position == "exact":
        return found
    first = rows.where("pos = 0").select("edge_ord", F.col("var_ord").alias("v"))
    return found.drop("var_ord").join(first, "edge_ord").withColumnRenamed("v", "var_ord")


def incoming_sums(rows: DataFrame) -> DataFrame:
    """(node_id, node_type, nb, bt)"""
    return incoming(rows).groupBy(*NODE).agg(F.count("*").alias("nb"), F.first("bt").alias("bt"))


def outgoing_sums(rows: DataFrame) -> DataFrame:
    """(node_id, node_type, nf, ft): ft is the type of the first edge."""
    return outgoing(rows).groupBy(*NODE).agg(F.count("*").alias("nf"), F.min_by("edge_type", "edge_ord").alias("ft"))


def constraints(rows: DataFrame, position: str = "exact") -> DataFrame:
    """(node_id, node_type, var_ord, coef): for each node with edges on both sides one equation
    with right side 0."""
    into = rows.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), "edge_ord", "edge_type", "var_ord")
    edges = into.groupBy(*NODE, "edge_ord").agg(F.count("*").alias("nb"), F.first("edge_type").alias("bt"))
    first = edges.groupBy(*NODE).agg(F.min(F.struct("edge_ord", "nb", "bt")).alias("first")).select(*NODE, "first.*")
    both = first.join(outgoing_sums(rows), NODE)
    scale_in = F.when(F.col("ft") == AND, F.col("nf")).otherwise(F.lit(1))
    scale_out = F.when(F.col("bt") == AND, F.col("nb")).otherwise(F.lit(1))
    both = both.where(F.col("bt").isin(AND, OR) & F.col("ft").isin(AND, OR)).select(*NODE, "edge_ord", scale_in.alias("s"), (-scale_out).alias("o"))
    plus = into.join(both, [*NODE, "edge_ord"]).select(*NODE, "var_ord", F.col("s").cast("long").alias("coef"))
    minus = outgoing(rows, position).join(both.drop("edge_ord"), NODE).select(*NODE, "var_ord", F.col("o").cast("long").alias("coef"))
    return plus.unionByName(minus).groupBy(*NODE, "var_ord").agg(F.sum("coef").alias("coef")).where("coef <> 0")


def sink(rows: DataFrame) -> DataFrame:
    """(var_ord, coef): the one equation with right side 1, over the edges into models that lead
    nowhere."""
    ends = outgoing(rows).select(*NODE)
    return incoming(rows).where(F.col("node_type") == MODEL).join(ends, NODE, "left_anti").groupBy("var_ord").agg(F.count("*").alias("coef"))


def objective(rows: DataFrame) -> DataFrame:
    """(var_ord, weight)"""
    return rows.select("var_ord", "weight")


def named_constraints(rows: DataFrame, position: str = "exact") -> DataFrame:
    """constraints and sink with a name for display: c0, c1 ... by node, the sink last."""
    from ..functions.ranks import ordinals

    found = constraints(rows, position)
    names = ordinals(found.select(*NODE).distinct(), NODE, "ord")
    body = found.join(names, NODE).select(F.concat(F.lit("c"), F.col("ord").cast("string")).alias("constraint"), "var_ord", "coef", F.lit(0).alias("rhs"))
    last = sink(rows).crossJoin(names.agg(F.count("*").alias("n")))  # one row
    return body.unionByName(last.select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("constraint"), "var_ord", "coef", F.lit(1).alias("rhs")))
