"""Incidences stored by node, so that what is asked at nodes needs no exchange.

Two tables in the shared folder, one by each incidence's destination and one by its source, both
bucketed and sorted by one column, ``node`` (type and id), into as many buckets: sums at nodes, joins
of both sides and steps along edges find a node's rows in one task, and a look-up reads one bucket.
A bucket is the work of one task, so a node with very many rows (``hot_rows`` on either side) must not
lie in one: such nodes are kept beside them in plain tables, and what is asked there goes through
partial sums and exchanges as everywhere else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AND, OR
from ..functions.lineage import cut, delete, shared_dir, written

NODE = ["node", "node_id", "node_type"]


def _node(node_id: Column, node_type: Column) -> Column:
    return F.concat_ws(":", node_type, node_id).alias("node")


class ByNode:
    """``with ByNode(rows) as stored: ...``; rows are a flow graph's numbered incidences. The tables go
    at the end, so results must be cut before."""

    def __init__(self, rows: DataFrame, n_buckets: int = 16, hot_rows: int = 1_000_000) -> None:
        self.spark, self.n_buckets = rows.sparkSession, n_buckets
        name = f"by_node_{uuid.uuid4().hex}"
        self.path, self.names = f"{shared_dir(self.spark).rstrip('/')}/{name}", []
        sides = {
            side: rows.select(_node(F.col(side), F.col(f"{side}_type")), F.col(side).alias("node_id"), F.col(f"{side}_type").alias("node_type"), *[c for c in rows.columns if c not in (side, f"{side}_type")])
            for side in ("dst", "src")
        }
        sizes = [df.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("node") for df in sides.values()]
        self.hot_nodes = cut(sizes[0].unionByName(sizes[1]).distinct())
        self.cold, self.hot = {}, {}
        for side, df in sides.items():
            self.names.append(f"{name}_{side}")
            cold = df.join(self.hot_nodes, "node", "left_anti")
            cold.repartition(n_buckets, "node").write.bucketBy(n_buckets, "node").sortBy("node").option("path", f"{self.path}/{side}").saveAsTable(self.names[-1])
            self.cold[side] = self.spark.table(self.names[-1])
            df.join(self.hot_nodes, "node", "left_semi").write.parquet(f"{self.path}/{side}_hot")
            self.hot[side] = written(self.spark, df.schema, f"{self.path}/{side}_hot")

    def __enter__(self) -> ByNode:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.path)

    def _both(self, of) -> DataFrame:
        """What is asked at nodes, at ordinary and at hot ones. No node is in both."""
        return of(self.cold).unionByName(of(self.hot))

    # ------------------------------------------------------------ sums and equations

    @staticmethod
    def _bk(t: dict) -> DataFrame:
        edges = t["dst"].groupBy(*NODE, "edge_ord").agg(F.count("*").alias("n"), F.first("edge_type").alias("edge_type"))
        return edges.groupBy(*NODE).agg(F.min_by("n", "edge_ord").alias("nb"), F.min_by("edge_type", "edge_ord").alias("bt"), F.min("edge_ord").alias("first_edge"))

    @staticmethod
    def _fr(t: dict) -> DataFrame:
        edges = t["src"].groupBy(*NODE, "edge_ord").agg(F.first("edge_type").alias("edge_type"))
        return edges.groupBy(*NODE).agg(F.count("*").alias("nf"), F.min_by("edge_type", "edge_ord").alias("ft"))

    @classmethod
    def _equations(cls, t: dict) -> DataFrame:
        both = cls._bk(t).join(cls._fr(t).drop("node_id", "node_type"), "node").where(F.col("bt").isin(AND, OR) & F.col("ft").isin(AND, OR))
        both = both.select(*NODE, "first_edge", F.when(F.col("ft") == AND, F.col("nf")).otherwise(F.lit(1)).alias("s"), (-F.when(F.col("bt") == AND, F.col("nb")).otherwise(F.lit(1))).alias("o"))
        # no edge is before the first; an equality here would be one more key, and buckets go by node alone
        into = t["dst"].select("node", "edge_ord", "var_ord").join(both, "node").where(F.col("edge_ord") <= F.col("first_edge")).select(*NODE, "var_ord", F.col("s").cast("long").alias("coef"))
        own = t["src"].groupBy("node", "edge_ord").agg(F.min_by("var_ord", "pos").alias("var_ord"))
        out = own.join(both, "node").select(*NODE, "var_ord", F.col("o").cast("long").alias("coef"))
        # a variable may stand on both sides of a node: the terms of one node and variable are added up
        return into.unionByName(out).groupBy(*NODE, "var_ord").agg(F.sum("coef").alias("coef")).where("coef <> 0")

    def incoming_sums(self) -> DataFrame:
        """``program.incoming_sums``, without an exchange but for hot nodes."""
        return self._both(self._bk).select("node_id", "node_type", "nb", "bt")

    def outgoing_sums(self) -> DataFrame:
        """``program.outgoing_sums``, without an exchange but for hot nodes."""
        return self._both(self._fr).select("node_id", "node_type", "nf", "ft")

    def constraints(self) -> DataFrame:
        """``program.constraints``: both sides of a node meet where they lie; only the terms found, no
        incidences, are exchanged, to add up those of one variable."""
        return self._both(self._equations).select("node_id", "node_type", "var_ord", "coef")

    # ------------------------------------------------------------ look-ups and steps

    def found(self, node_id: str, node_type: str, side: str) -> DataFrame:
        """The incidences with the node as their destination or source: one bucket's rows."""
        key = f"{node_type}:{node_id}"
        return self._both(lambda t: t[side].where(F.col("node") == key))

    def sources_of(self, last: DataFrame) -> DataFrame:
        """(node_id, node_type): a step back from last's nodes; last alone is exchanged."""
        at = last.select(_node(F.col("node_id"), F.col("node_type"))).distinct()
        return self._both(lambda t: t["dst"].join(at, "node").select(F.col("src").alias("node_id"), F.col("src_type").alias("node_type"))).distinct()
