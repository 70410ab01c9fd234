"""Both graphs after a change of documents, without building them anew.

A hyperedge hangs on the documents along a short chain: an aligned group on its first record, this
one's first parent, the parent's group and that group's records; a run on its input groups; a post-
synchronised group on its records and their parents. A connector hangs on the node, its first child
and up to two of its ancestors. Chains are followed upwards from the changed documents to find whose
edges may differ, and only the rows that these need are read for them, with the same functions that
build a whole graph. One state of the tables is enough to follow them in: a link that changed lies in
a document that changed, so the part of the chain before the first changed document is in both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ALIGNMENT, POST_SYNC
from ..functions.lineage import Scratch, stored
from ..sources.buckets import BucketTable
from ..sources.documents import Tables
from ..sources.indexed import HEAD, IndexedTables, at_once, ids
from . import model_graph
from .flow_graph import FlowGraph, am_to_job, cluster_to_model, hyperedges, incidences, job_to_cluster, model_to_am

#: (table, column, wanted ids) to the table's rows whose column is one of them.
Look = Callable[[str, str, DataFrame], DataFrame]

OWNED = ["stage", "owner"]
ROWS = (
    "stage int, owner string, key string, kind int, nth long, dst string, dst_kind string, dst_type string, dst_model string, edge_type string, "
    "src string, src_kind string, src_type string, src_model string, pos int, weight double"
)
EDGES = "stage int, owner string, key string, kind int, nth long, dst string, dst_kind string, dst_type string, dst_model string, edge_type string, n_sources long, weight double"
NODES = "dsir_id string, name string, t_begin int, t_end int"
LINKS = "dsir_id string, via string, pos1 int, pos2 int"


def over(t: Tables) -> Look:
    """Look-ups in plain tables: a scan of each, for tables that are not stored by their ids."""
    return lambda name, column, wanted: t[name].join(wanted.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).where("id IS NOT NULL").distinct()


def owned(df: DataFrame) -> DataFrame:
    """Incidences or edges with the document whose change makes them anew: a run's number or the
    group."""
    return df.withColumn("owner", F.when(F.col("stage") == 2, F.col("nth").cast("string")).otherwise(F.col("key")))


def touched(look: Look, changed: dict[str, DataFrame], keep) -> dict[str, DataFrame]:
    """Whose edges may differ: aligned groups, runs (by job), post-synchronised groups and nodes of
    the model graph, as ids. changed has the ids of records, groups and jobs by the id's column, keep
    writes down what is used again."""
    records, groups, jobs = (changed[c] for c in ("dsir_id", "dsar_id", "job_id"))
    above = keep(look("dsir_parent", "parent_id", records).select("dsir_id", "pos"))
    within = keep(look("dsar_dsir", "dsir_id", records).select("dsar_id", "pos"))
    # aligned groups: from a record to its groups, to the records that these own, their first children, and those's groups
    parents = keep(_union(records, ids(look("dsir", "dsar_id", keep(_union(groups, ids(within, "dsar_id")))), "dsir_id")))
    firsts = keep(_union(records, ids(look("dsir_parent", "parent_id", parents).where("pos = 0"), "dsir_id")))
    aligned = keep(_union(ids(look("dsar_dsir", "dsir_id", firsts).where("pos = 0"), "dsar_id")))
    members = keep(_union(ids(above, "dsir_id")))
    synced = keep(_union(ids(within, "dsar_id"), ids(look("dsar_dsir", "dsir_id", members), "dsar_id")))
    # a changed group counts whoever makes it now: it may have edges from before
    made = lambda found, by: _union(groups, ids(look("dsar", "dsar_id", found).where(F.col("created_by") == by), "dsar_id"))
    runs = _union(jobs, ids(look("job_dsar", "dsar_id", groups), "job_id"))
    # nodes: by their first child, and by ancestors that their hops pass through
    stands = ids(look("dsir_child", "child_id", records).where("pos = 0"), "dsir_id")
    third = keep(_union(ids(look("dsir_parent", "parent_id", members), "dsir_id")))
    results = ids(look("dsir", "dsir_id", third).where(F.col("created_by") == POST_SYNC), "dsir_id")
    return {"aligned": keep(made(aligned, ALIGNMENT)), "runs": keep(runs), "synced": keep(made(synced, POST_SYNC)), "nodes": keep(_union(records, stands, members, results))}


def _aligned(look: Look, groups: DataFrame, keep) -> DataFrame:
    own = keep(look("dsar_dsir", "dsar_id", groups))
    parents = keep(look("dsir_parent", "dsir_id", ids(own.where("pos = 0"), "dsir_id")).where("pos = 0"))
    holders = _union(groups, ids(look("dsir", "dsir_id", ids(parents, "parent_id")), "dsar_id"))
    lists = keep(look("dsar_dsir", "dsar_id", keep(holders)))
    records = keep(look("dsir", "dsir_id", keep(_union(ids(parents, "parent_id"), ids(lists, "dsir_id")))))
    return model_to_am({"dsar": look("dsar", "dsar_id", groups), "dsar_dsir": lists, "dsir_parent": parents, "dsir": records})


def _runs(look: Look, jobs: DataFrame, keep) -> DataFrame:
    inputs = keep(look("job_dsar", "job_id", jobs))
    return am_to_job({"job": look("job", "job_id", jobs), "job_dsar": inputs, "dsar": look("dsar", "dsar_id", keep(_union(ids(inputs, "dsar_id"))))})


def _synced(look: Look, groups: DataFrame, keep) -> Tables:
    lists = keep(look("dsar_dsir", "dsar_id", groups))
    parents = keep(look("dsir_parent", "dsir_id", keep(_union(ids(lists, "dsir_id")))))
    records = keep(look("dsir", "dsir_id", keep(_union(ids(lists, "dsir_id"), ids(parents, "parent_id")))))
    return {"dsar": keep(look("dsar", "dsar_id", groups)), "dsar_dsir": lists, "dsir_parent": parents, "dsir": records}


def flow_of(look: Look, found: dict[str, DataFrame], keep) -> tuple[DataFrame, DataFrame]:
    """(incidences, hyperedges) of the touched groups and runs."""
    synced = _synced(look, found["synced"], keep)
    parts = [_aligned(look, found["aligned"], keep), _runs(look, found["runs"], keep), job_to_cluster(synced), cluster_to_model(synced)]
    rows = keep(owned(reduce(DataFrame.unionByName, parts)))
    return rows, keep(owned(hyperedges(synced, rows)))


def links_of(look: Look, found: dict[str, DataFrame], keep) -> tuple[DataFrame, DataFrame]:
    """(nodes, connectors but for their last hop) of the touched nodes of the model graph."""
    nodes = found["nodes"]
    first = keep(look("dsir_child", "dsir_id", nodes).where("pos = 0"))
    one = keep(look("dsir_parent", "dsir_id", nodes))
    results = look("dsir", "dsir_id", nodes).where(F.col("created_by") == POST_SYNC).select("dsir_id")
    far = one.join(results, "dsir_id", "left_semi")  # only results go a second hop before the last
    two = keep(look("dsir_parent", "dsir_id", keep(_union(ids(far, "parent_id")))))
    hops = keep(_union(nodes, ids(one, "parent_id"), ids(two, "parent_id")))
    # a row that is in both is in one alone
    links = one.unionByName(two.join(one.select("dsir_id").distinct(), "dsir_id", "left_anti"))
    t = {"dsir": keep(look("dsir", "dsir_id", keep(_union(hops, ids(first, "child_id"))))), "dsir_child": first, "dsir_parent": keep(links)}
    own = nodes.select(F.col("id").alias("dsir_id"))
    # what lies on the way may be a node too, but not all that it needs is here
    return keep(model_graph.nodes(t).join(own, "dsir_id", "left_semi")), keep(model_graph.all_stubs(t).join(own, "dsir_id", "left_semi"))


def changes(new: Tables, gone: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The ids of the changed documents by the id's column: those of new, and those that are gone."""
    found = {column: ids(new[table], column) for column, table in HEAD.items()}
    return {column: _union(df, ids((gone or {})[column], column)) if column in (gone or {}) else _union(df) for column, df in found.items()}


class StoredLinks(BucketTable):
    """Connectors, stored but for their last hop (``model_graph.all_stubs``), which is read from the
    stored parents: the table is as large as the links between documents, however many connectors
    they make, and a record whose parents alone change costs it nothing."""

    def __init__(self, tables: IndexedTables, spark: SparkSession, path: str, n_buckets: int) -> None:
        super().__init__(spark, path, LINKS, ["dsir_id"], n_buckets)
        self.parents = tables.copies["dsir_parent", "dsir_id"]

    def stubs(self) -> DataFrame:
        return super().read()

    def read(self, snapshot: int | None = None) -> DataFrame:
        """(dsir_id, connect_to, pos1, pos2, pos3): of a snapshot over the parents as they are now."""
        return model_graph.connected(super().read(snapshot), self.parents.read())


class StoredGraphs:
    """Tables of documents and both graphs over them in a folder, kept up by changes.

    Incidences and hyperedges lie by the group or run that they are made for, nodes and connectors by
    the node. They carry keys, not numbers: numbers are ranks in the order of all keys, so ``flow``
    gives them afresh. A change that was cut short is made whole by making it again."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64) -> None:
        self.spark, path = spark, path.rstrip("/")
        self.tables = IndexedTables(spark, f"{path}/tables", n_buckets)
        make = lambda name, schema, keys: BucketTable(spark, f"{path}/{name}", schema, keys, n_buckets)
        self.rows, self.edges = make("rows", ROWS, OWNED), make("edges", EDGES, OWNED)
        self.nodes, self.links = make("nodes", NODES, ["dsir_id"]), StoredLinks(self.tables, spark, f"{path}/links", n_buckets)

    def build(self, t: Tables) -> None:
        """Fills an empty folder."""
        self.tables.load(t)
        rows = stored(incidences(t))
        parts = ((self.rows, owned(rows)), (self.edges, owned(hyperedges(t, rows))), (self.nodes, model_graph.nodes(t)), (self.links, model_graph.all_stubs(t)))
        at_once([partial(table.insert, df) for table, df in parts])

    def change(self, new: Tables, gone: dict[str, DataFrame] | None = None) -> dict[str, int]:
        """Takes in documents that are new or differ (all rows of each in new), and takes out those
        whose ids are in gone (by the id's column). How many edges' owners and nodes were made anew."""
        with Scratch(self.spark) as keep:
            new = {name: keep(df) for name, df in new.items()}
            changed = {column: keep(df) for column, df in changes(new, gone).items()}
            self.tables.change(new, changed)
            found = touched(self.tables.look, changed, keep)
            owners = lambda stage, name: found[name].select(F.lit(stage).alias("stage"), F.col("id").cast("string").alias("owner"))
            out = keep(reduce(DataFrame.unionByName, [owners(1, "aligned"), owners(2, "runs"), owners(3, "synced")]))
            rows, edges = flow_of(self.tables.look, found, keep)
            nodes, links = links_of(self.tables.look, found, keep)
            own = found["nodes"].select(F.col("id").alias("dsir_id"))
            parts = ((self.rows, out, rows), (self.edges, out, edges), (self.nodes, own, nodes), (self.links, own, links))
            at_once([partial(table.replace, left, added) for table, left, added in parts])
            return {name: df.count() for name, df in found.items()}

    def flow(self) -> FlowGraph:
        """The flow graph as it is now, numbered."""
        return FlowGraph(self.tables.read(), self.rows.read().drop("owner"), self.edges.read().drop("owner"))
