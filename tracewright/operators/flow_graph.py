"""The flow graph: hyperedges with many sources and one destination, built in four stages.

A row of the incidence table is one source of one hyperedge. A hyperedge's key is (stage, key, kind,
nth): stage 1 by aligned group, 2 by run output, 3 and 4 by post-synchronised group, its records'
edges (kind 0, nth = position) before the group's own (kind 1). The key is also the build order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AM, AND, ALIGNMENT, CLUSTER, DSAR, DSIR, JOB, JOB_GATEWAY, MODEL, OR, POST_SYNC, hash_weight
from ..functions.lineage import stored
from ..functions.ranks import ordinals, positions
from ..sources.documents import Tables
from ..sources.store import push, upsert

KEY = ["stage", "key", "kind", "nth"]
ROW = [*KEY, "dst", "dst_kind", "dst_type", "dst_model", "edge_type", "src", "src_kind", "src_type", "src_model", "pos", "weight"]


def _rows(df: DataFrame, stage: int, key: str, dst: tuple, src: tuple, edge_type: str, weight=None, kind: int = 0, nth=None) -> DataFrame:
    """dst and src: (id column, record kind, node type, model column)."""
    named = df.select(
        F.lit(stage).alias("stage"), F.col(key).alias("key"), F.lit(kind).alias("kind"), (F.col(nth) if nth else F.lit(0)).cast("long").alias("nth"),
        F.col(dst[0]).alias("dst"), F.lit(dst[1]).alias("dst_kind"), F.lit(dst[2]).alias("dst_type"), F.col(dst[3]).alias("dst_model"), F.lit(edge_type).alias("edge_type"),
        F.col(src[0]).alias("src"), F.lit(src[1]).alias("src_kind"), F.lit(src[2]).alias("src_type"), F.col(src[3]).alias("src_model"), F.col("pos").cast("int").alias("pos"),
        *([F.col(weight).alias("weight")] if weight else []),
    )
    return named if weight else named.withColumn("weight", hash_weight(F.col("dst_type"), F.col("dst"), F.col("src"), F.col("pos")))


def model_to_am(t: Tables) -> DataFrame:
    """Stage 1: an aligned group with records takes its first record's first parent's group, and
    each record of that group is a source."""
    groups = t["dsar"].where(F.col("created_by") == ALIGNMENT).select("dsar_id", F.col("model_type").alias("am_model"))
    first = t["dsar_dsir"].where("pos = 0").select("dsar_id", F.col("dsir_id").alias("d"))
    parent = t["dsir_parent"].where("pos = 0").select(F.col("dsir_id").alias("d"), F.col("parent_id").alias("p"))
    owner = t["dsir"].select(F.col("dsir_id").alias("p"), F.col("dsar_id").alias("w"))
    members = t["dsar_dsir"].select(F.col("dsar_id").alias("w"), "pos", F.col("dsir_id").alias("x"))
    record = t["dsir"].select(F.col("dsir_id").alias("x"), F.col("dsar_id").alias("x_dsar"), F.col("model_type").alias("x_model"))
    df = groups.join(first, "dsar_id").join(parent, "d").join(owner, "p").join(members, "w").join(record, "x")
    return _rows(df, 1, "dsar_id", ("dsar_id", DSAR, AM, "am_model"), ("x_dsar", DSAR, MODEL, "x_model"), AND)


def am_to_job(t: Tables) -> DataFrame:
    """Stage 2: a run takes each of its input groups; weights are its relevance."""
    groups = t["dsar"].select("dsar_id", F.col("model_type").alias("am_model"))
    df = t["job"].join(t["job_dsar"], "job_id").join(groups, "dsar_id")
    return _rows(df, 2, "output_dsir", ("output_dsir", DSIR, JOB, "model_type"), ("dsar_id", DSAR, AM, "am_model"), OR, "relevance", nth="job_id")


def _members(t: Tables) -> DataFrame:
    groups = t["dsar"].where(F.col("created_by") == POST_SYNC).select("dsar_id", F.col("model_type").alias("group_model"))
    member = t["dsar_dsir"].select("dsar_id", F.col("pos").alias("nth"), F.col("dsir_id").alias("d"))
    record = t["dsir"].select(F.col("dsir_id").alias("d"), F.col("t_begin").alias("b"), F.col("t_end").alias("e"), F.col("model_type").alias("d_model"))
    return groups.join(member, "dsar_id").join(record, "d")


def job_to_cluster(t: Tables) -> DataFrame:
    """Stage 3: a post-synchronised record takes its parents that are runs of its window and model;
    without one, it takes a stand-in run with its own id."""
    members = _members(t)
    parent = t["dsir_parent"].select(F.col("dsir_id").alias("d"), F.col("pos").alias("at"), F.col("parent_id").alias("p"))
    run = t["dsir"].where(F.col("created_by") == JOB_GATEWAY).select(F.col("dsir_id").alias("p"), F.col("t_begin").alias("b"), F.col("t_end").alias("e"), F.col("model_type").alias("d_model"))
    found = members.join(parent, "d").join(run, ["p", "b", "e", "d_model"]).withColumn("p_model", F.col("d_model"))
    found = positions(found, ["dsar_id", "nth", "d"], "at", "pos")
    alone = members.join(found.select("d").distinct(), "d", "left_anti").withColumn("pos", F.lit(0))
    made = _rows(found, 3, "dsar_id", ("d", DSIR, CLUSTER, "d_model"), ("p", DSIR, JOB, "p_model"), OR, nth="nth")
    return made.unionByName(_rows(alone, 3, "dsar_id", ("d", DSIR, CLUSTER, "d_model"), ("d", DSIR, JOB, "d_model"), OR, nth="nth"))


def cluster_to_model(t: Tables) -> DataFrame:
    """Stage 4: a post-synchronised group takes all its records."""
    df = _members(t).withColumn("pos", F.col("nth"))
    return _rows(df, 3, "dsar_id", ("dsar_id", DSAR, MODEL, "group_model"), ("d", DSIR, CLUSTER, "d_model"), AND, kind=1)


def incidences(t: Tables) -> DataFrame:
    return model_to_am(t).unionByName(am_to_job(t)).unionByName(job_to_cluster(t)).unionByName(cluster_to_model(t)).select(*ROW)


def hyperedges(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """One row for each hyperedge, with its number of sources; a post-synchronised group without
    records is an edge of no source."""
    rows = incidences(t) if rows is None else rows
    found = rows.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("dst", "dst_kind", "dst_type", "dst_model", "edge_type")], F.count("*").alias("n_sources"), F.sum("weight").alias("weight"))
    empty = t["dsar"].where(F.col("created_by") == POST_SYNC).join(t["dsar_dsir"].select("dsar_id").distinct(), "dsar_id", "left_anti")
    empty = empty.select(
        F.lit(3).alias("stage"), F.col("dsar_id").alias("key"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("nth"), F.col("dsar_id").alias("dst"), F.lit(DSAR).alias("dst_kind"),
        F.lit(MODEL).alias("dst_type"), F.col("model_type").alias("dst_model"), F.lit(AND).alias("edge_type"), F.lit(0).cast("long").alias("n_sources"), F.lit(0.0).alias("weight"),
    )
    return found.unionByName(empty)


class FlowGraph:
    """A built flow graph: edges (numbered) and rows (their sources, with edge and variable
    numbers), cut once and shared by all that reads them."""

    def __init__(self, t: Tables, rows: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        raw = stored(incidences(t) if rows is None else rows)
        self.edges = ordinals(hyperedges(t, raw) if edges is None else edges, KEY, "edge_ord")
        numbered = raw.join(self.edges.select(*KEY, "edge_ord"), KEY)
        self.rows = ordinals(numbered, ["edge_ord", "pos"], "var_ord")

    def names(self) -> DataFrame:
        """Edges by name, e0, e1 ... in build order."""
        return self.edges.select(F.concat(F.lit("e"), F.col("edge_ord").cast("string")).alias("edge_name"), "dst", "dst_type", "edge_type", "n_sources")

    def nodes(self) -> DataFrame:
        """(node_id, node_type) with the record kind and model of the last writer."""
        return registry(self.rows, self.edges)

    def adjacency(self) -> DataFrame:
        return adjacency(self.rows, self.edges)

    def degrees(self) -> DataFrame:
        return degrees(self.rows, self.edges)


def registry(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node once; of several writers the last counts: the later edge, and in an edge its
    destination after its sources."""
    seq = lambda last: (F.col("edge_ord") * 2 + last).alias("seq")
    sources = rows.select(F.col("src").alias("node_id"), F.col("src_type").alias("node_type"), F.col("src_kind").alias("type"), F.col("src_model").alias("model_type"), seq(0))
    ends = edges.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), F.col("dst_kind").alias("type"), F.col("dst_model").alias("model_type"), seq(1))
    return upsert(sources.unionByName(ends), ["node_id", "node_type"], "seq").select("node_id", "type", "node_type", "model_type")


def adjacency(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node the names of the edges that it is a source of (once for each position) and the
    destination of, in build order."""
    name = F.concat(F.lit("e"), F.col("edge_ord").cast("string")).alias("name")
    keys = ["node_id", "node_type"]
    out = push(rows.select(F.col("src").alias("node_id"), F.col("src_type").alias("node_type"), "edge_ord", name), keys, "name", "edge_ord", "source_edge")
    into = push(edges.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), "edge_ord", name), keys, "name", "edge_ord", "destination_edge")
    return out.join(into, keys, "full_outer")


def degrees(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """adjacency's list lengths, without the lists."""
    none = F.lit(0).cast("long")
    out = rows.groupBy(F.col("src").alias("node_id"), F.col("src_type").alias("node_type")).agg(F.count("*").alias("n_out")).withColumn("n_in", none)
    into = edges.groupBy(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type")).agg(F.count("*").alias("n_in")).withColumn("n_out", none)
    return out.unionByName(into).groupBy("node_id", "node_type").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
