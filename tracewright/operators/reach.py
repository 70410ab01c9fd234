"""Timelines by look-up: an index of what is behind and ahead of every node, built once.

Nodes with the same set of sources have the same behind them, so they are one class there; a flow
graph's runs fall into a few classes for each window. Ahead, an edge leads to its other sources as
well, so edges that share a source lead to the same places: they are one class, found as connected
components over edges alone. What is left is a small graph of classes, closed by squaring (log of its
depth rounds, whatever the number of paths). A timeline is then a look-up: class, reached classes,
their members. ``models`` holds the answer of the service, the model nodes in each model's timeline,
as a table of its own.

The closure holds a row for each class and class that it reaches: it is made for graphs whose classes
are few (by model and window), not for ones where every node is a class of its own; for those
``traverse`` walks from one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Scratch, cut
from .components import components

NODE = ["node_id", "node_type"]


def _ends(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("edge_ord", F.col(side).alias("node_id"), F.col(f"{side}_type").alias("node_type"))


def closed(arcs: DataFrame, keep: Scratch, max_rounds: int = 64) -> DataFrame:
    """arcs(a, b) to all (a, b) where b is reached from a, in no step too where a has an arc."""
    nodes = arcs.select("a", F.col("a").alias("b")).unionByName(arcs.select(F.col("b").alias("a"), "b"))
    reach = keep(arcs.select("a", "b").unionByName(nodes).distinct())
    n = reach.count()
    for _ in range(max_rounds):
        further = reach.select("a", F.col("b").alias("m")).join(reach.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        reach, before = keep(further), n
        n = reach.count()
        if n == before:
            return reach
    raise RuntimeError(f"no end after {max_rounds} rounds")


class Timelines:
    """behind and ahead: of(node_id, node_type, class), reach(a, b) and members(class, node_id,
    node_type). A node of no class reaches nothing but itself."""

    def __init__(self, rows: DataFrame) -> None:
        with Scratch(rows.sparkSession) as keep:
            self.behind = self._behind(rows, keep)
            self.ahead = self._ahead(rows, keep)
            self.models = cut(self._models(rows))

    def _behind(self, rows: DataFrame, keep: Scratch) -> tuple:
        links = rows.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), "src", "src_type").distinct()
        links = keep(links)
        source = [F.col("src"), F.col("src_type")]
        signs = links.groupBy(*NODE).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*source)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *source)).alias("y"))
        of = keep(signs.select(*NODE, F.xxhash64("n", "x", "y").alias("class")))
        one = of.groupBy("class").agg(F.min_by(F.struct(*NODE), F.struct(*NODE)).alias("x")).select("class", "x.*")
        members = keep(links.join(one, NODE).select("class", F.col("src").alias("node_id"), F.col("src_type").alias("node_type")))
        arcs = members.join(of.withColumnRenamed("class", "b"), NODE).select(F.col("class").alias("a"), "b").distinct()
        return cut(of), cut(closed(keep(arcs), keep)), cut(members)

    def _ahead(self, rows: DataFrame, keep: Scratch) -> tuple:
        sources, ends = keep(_ends(rows, "src").distinct()), keep(_ends(rows, "dst").distinct())
        hub = sources.groupBy(*NODE).agg(F.min("edge_ord").alias("b"))
        links = sources.join(hub, NODE).where("edge_ord <> b").select(F.col("edge_ord").alias("a"), "b").distinct()
        edges = sources.select(F.col("edge_ord").alias("node")).distinct()
        roots = keep(components(edges, keep(links)).toDF("edge_ord", "class"))
        of = keep(sources.join(roots, "edge_ord").groupBy(*NODE).agg(F.min("class").alias("class")))
        members = keep(sources.unionByName(ends).join(roots, "edge_ord").select("class", *NODE).distinct())
        arcs = ends.join(roots, "edge_ord").select(F.col("class").alias("a"), *NODE).join(of.withColumnRenamed("class", "b"), NODE).select("a", "b").distinct()
        return cut(of), cut(closed(keep(arcs), keep)), cut(members)

    @staticmethod
    def _reached(starts: DataFrame, index: tuple, members: DataFrame | None = None) -> DataFrame:
        """starts(start, node_id, node_type) to (start, node_id, node_type): what they reach."""
        of, reach, held = index
        held = held if members is None else members
        first = starts.join(of, NODE).select("start", F.col("class").alias("a"))
        # a class without arcs has no row in reach and reaches itself
        classes = first.join(reach, "a", "left").select("start", F.coalesce("b", "a").alias("class"))
        found = classes.join(held, "class").select("start", *NODE)
        return found.unionByName(starts.select("start", *NODE)).distinct()

    def _models(self, rows: DataFrame) -> DataFrame:
        ends = _ends(rows, "src").unionByName(_ends(rows, "dst")).where("node_type = 'model'").select(*NODE).distinct()
        starts = ends.select(F.col("node_id").alias("start"), *NODE)
        out = None
        for direction, index in (("backward", self.behind), ("forward", self.ahead)):
            found = self._reached(starts, index, index[2].where("node_type = 'model'")).withColumn("direction", F.lit(direction))
            out = found if out is None else out.unionByName(found)
        return out.where("direction = 'forward' or node_id <> start").select("start", "node_id", "direction")

    def _start(self, node_id: str, node_type: str) -> DataFrame:
        spark = self.models.sparkSession
        return spark.createDataFrame([(node_id, node_id, node_type)], "start string, node_id string, node_type string")

    def backward(self, node_id: str, node_type: str = "model") -> DataFrame:
        """(node_id, node_type): the node and all that it came from."""
        return self._reached(self._start(node_id, node_type), self.behind).select(*NODE)

    def forward(self, node_id: str, node_type: str = "model") -> DataFrame:
        """(node_id, node_type): the node and all that it led to."""
        return self._reached(self._start(node_id, node_type), self.ahead).select(*NODE)

    def timeline(self, node_id: str, node_type: str = "model") -> DataFrame:
        """(node_id, node_type, direction): what is behind the node, without it, and what is ahead,
        with it."""
        behind = self.backward(node_id, node_type).where(~((F.col("node_id") == node_id) & (F.col("node_type") == node_type)))
        return behind.withColumn("direction", F.lit("backward")).unionByName(self.forward(node_id, node_type).withColumn("direction", F.lit("forward")))

    def model_timeline(self, node_id: str) -> DataFrame:
        """(node_id): the model nodes of a model's timeline; a model that is in no edge has itself."""
        found = self.models.where(F.col("start") == node_id).select("node_id")
        return found.unionByName(self._start(node_id, "model").select("node_id").join(found.select("node_id"), "node_id", "left_anti"))

    def sizes(self) -> DataFrame:
        """(start, direction, n_nodes) of every model: how many nodes its timeline has."""
        starts = self.models.select("start").distinct().select("start", F.col("start").alias("node_id"), F.lit("model").alias("node_type"))
        out = None
        for direction, index, own in (("backward", self.behind, 1), ("forward", self.ahead, 0)):
            found = self._reached(starts, index).groupBy("start").agg((F.count("*") - own).alias("n_nodes")).select("start", F.lit(direction).alias("direction"), "n_nodes")
            out = found if out is None else out.unionByName(found)
        return out
