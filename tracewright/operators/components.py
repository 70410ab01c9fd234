"""Connected components of a table of links by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Scratch, stored


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """nodes(node), links(a, b) to (node, root): root is the component's smallest node. In each round
    a node goes to its least neighbour, if that is smaller, and on to where that one ends; what is
    left are links between ends. After two rounds every end has taken in another node at least, so
    the tables halve: only the first round is the work of all links."""
    with Scratch(nodes.sparkSession) as keep:
        links, steps = keep(links.where("a <> b").select("a", "b")), []
        while not links.isEmpty():
            if len(steps) == max_rounds:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
            steps.append(keep(_ends(links, keep)))
            end = lambda side: steps[-1].toDF(side, f"{side}_end")
            links = links.join(end("a"), "a").join(end("b"), "b").where("a_end <> b_end").select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))
            links = keep(links.distinct())
        found = steps.pop() if steps else None
        for step in reversed(steps):
            later = found.toDF("end", "root")
            found = keep(step.join(later, "end", "left").select("node", F.coalesce("root", "end").alias("end")))
        all_nodes = nodes.select("node").distinct()
        if found is None:
            return stored(all_nodes.select("node", F.col("node").alias("root")))
        return stored(all_nodes.join(found, "node", "left").select("node", F.coalesce("end", "node").alias("root")))


def _ends(links: DataFrame, keep: Scratch) -> DataFrame:
    """(node, end): where the ways to ever smaller neighbours end. Only nodes that others go to are
    looked at more than once, and each look doubles the ways."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("end")))
    ends = keep(ways.join(ways.where("node <> end").select(F.col("end").alias("node")).distinct(), "node", "left_semi"))
    while not ends.where("node <> end").isEmpty():
        further = keep(ends.join(ends.toDF("end", "further"), "end").select("node", "end", "further"))
        settled = further.where("end <> further").isEmpty()
        ends = further.select("node", F.col("further").alias("end"))
        if settled:
            break
    return ways.join(ends.toDF("end", "further"), "end", "left").select("node", F.coalesce("further", "end").alias("end"))
