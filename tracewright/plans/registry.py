"""Queries by name and their DuckDB equivalents, over provenance derived from orders."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import Scratch, cut, delete, shared_dir, stored
from ..operators import delta, drawing, model_graph, program, reach, solver, traverse
from ..operators.flow_graph import FlowGraph, am_to_job, cluster_to_model, hyperedges, job_to_cluster, model_to_am
from ..sources import documents, mini, store
from ..sources.buckets import BucketTable
from ..sources.by_node import ByNode
from ..sources.indexed import OWNER
from ..sources.orders import build, duckdb_tables, state, tables
from .api import Engine

BACK, AHEAD, MIDDLE, EARLY = "M5-2001", "M1-1995", "M3-1998", "M3-1996"
GROUP = ("S3-1996-3", "am")
_FLOWS: dict = {}
_SOLVED: dict = {}
_FIRST_SOLVED: dict = {}
_TIMELINES: dict = {}
_GROWN: dict = {}


def flow(spark: SparkSession, sf_dir: str) -> FlowGraph:
    """The flow graph of a folder, built once for a session and a state of its files."""
    key = state(spark, sf_dir)
    if key not in _FLOWS:
        _FLOWS.clear()
        _FLOWS[key] = FlowGraph(tables(spark, sf_dir))
    return _FLOWS[key]


def solution(spark: SparkSession, sf_dir: str) -> solver.Solution:
    """The program's solution, found once for a session and a state of the folder's files."""
    key = state(spark, sf_dir)
    if key not in _SOLVED:
        _SOLVED.clear()
        _SOLVED[key] = solver.solution(flow(spark, sf_dir).rows, second=True)
    return _SOLVED[key]


def solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = solution(spark, sf_dir)
    return found.chosen.withColumn("total", F.lit(found.total))


def solved_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution with each edge's first variable in a node's outgoing sum, which is no network."""
    key = state(spark, sf_dir)
    if key not in _FIRST_SOLVED:
        _FIRST_SOLVED.clear()
        _FIRST_SOLVED[key] = solver.solution(flow(spark, sf_dir).rows, "first")
    found = _FIRST_SOLVED[key]
    return found.chosen.withColumn("total", F.lit(found.total))


def timelines(spark: SparkSession, sf_dir: str) -> reach.Timelines:
    """The index of timelines, built once for a session and a state of the folder's files."""
    key = state(spark, sf_dir)
    if key not in _TIMELINES:
        _TIMELINES.clear()
        _TIMELINES[key] = reach.Timelines(flow(spark, sf_dir).rows)
    return _TIMELINES[key]


def _proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof that no choice is better: what each variable's gain at the solution's prices is off
    by, and how far the totals of choice and prices are apart."""
    rows = flow(spark, sf_dir).rows
    return solver.certificate(solution(spark, sf_dir), program.objective(rows), program.constraints(rows), program.sink(rows))


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next best choice and its total."""
    found = solution(spark, sf_dir)
    return found.second.withColumn("total", F.lit(found.second_exact / (1 << found.shift)))


def _equations(spark: SparkSession, sf_dir: str, choice=solved, position: str = "exact") -> DataFrame:
    """What every equation of the program comes to under the solution. SQL knows no solution, but
    what each equation must come to."""
    rows = flow(spark, sf_dir).rows
    chosen = choice(spark, sf_dir).select("var_ord", F.lit(1).alias("x"))
    one = rows.sparkSession.range(1).select(F.lit("sink").alias("node_id"), F.lit("").alias("node_type"))
    terms = program.constraints(rows, position).unionByName(program.sink(rows).crossJoin(one))  # one row
    return terms.join(chosen, "var_ord", "left").groupBy("node_id", "node_type").agg(F.sum(F.when(F.col("x") == 1, F.col("coef")).otherwise(0)).alias("value"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables and the flow graph built anew: how many rows each has."""
    made = build(spark, sf_dir)
    graph = FlowGraph(made)
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in (*made.items(), ("hyperedges", graph.edges), ("variables", graph.rows))]
    return reduce(DataFrame.unionByName, counts)


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(tables(spark, sf_dir), flow=flow(spark, sf_dir), chosen=solved(spark, sf_dir), timelines=timelines(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's three answers, as it writes them: model graph, records of the chosen models,
    timeline of a model. The second is the solver's, so SQL has no word on it."""
    engine = _engine(spark, sf_dir)
    found = {"model_graph": engine.model_graph_response(), "optimal_path": engine.response(engine.optimal_path()), "timeline": engine.response(engine.timeline(MIDDLE))}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("call"), "json") for name, df in found.items()])


def _answer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(tables(spark, sf_dir)).model_graph_response()


def _answer_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(tables(spark, sf_dir), flow=flow(spark, sf_dir), timelines=timelines(spark, sf_dir))
    return engine.response(engine.timeline(MIDDLE))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as documents, written as JSON, read and normalised again: runs by their records."""
    t = tables(spark, sf_dir)
    lists = lambda df, key, value, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("l")).select(key, F.col(f"l.{value}").alias(name))
    window = F.struct(F.col("t_begin").cast("long").alias("begin"), F.col("t_end").cast("long").alias("end"))
    dsir = t["dsir"].join(lists(t["dsir_parent"], "dsir_id", "parent_id", "parents"), "dsir_id", "left").join(lists(t["dsir_child"], "dsir_id", "child_id", "children"), "dsir_id", "left")
    dsir = dsir.select(F.col("dsir_id").alias("_id"), "created_by", F.struct("model_type", window.alias("temporal")).alias("metadata"), "parents", "children", F.col("dsar_id").alias("dsar"))
    dsar = t["dsar"].join(lists(t["dsar_dsir"], "dsar_id", "dsir_id", "dsir_list"), "dsar_id", "left")
    dsar = dsar.select(F.col("dsar_id").alias("_id"), "created_by", F.struct("model_type").alias("metadata"), "dsir_list")
    jobs = t["job"].join(lists(t["job_dsar"], "job_id", "dsar_id", "input_dsars"), "job_id", "left")
    jobs = jobs.select(F.col("job_id").cast("string").alias("_id"), "input_dsars", "output_dsir", "model_type", "relevance")
    folder = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    for name, df in (("dsir", dsir), ("dsar", dsar), ("jobs", jobs)):
        df.write.json(f"{folder}/{name}")
    again = documents.normalise(*documents.read_documents(spark, folder))
    runs = again["job"].join(again["job_dsar"], "job_id").select(F.col("output_dsir").alias("record"), F.col("dsar_id").alias("other"), "pos", F.lit("input").alias("side"))
    parents = again["dsir_parent"].select(F.col("dsir_id").alias("record"), F.col("parent_id").alias("other"), "pos", F.lit("parent").alias("side"))
    children = again["dsir_child"].select(F.col("dsir_id").alias("record"), F.col("child_id").alias("other"), "pos", F.lit("child").alias("side"))
    members = again["dsar_dsir"].select(F.col("dsar_id").alias("record"), F.col("dsir_id").alias("other"), "pos", F.lit("member").alias("side"))
    found = cut(runs.unionByName(parents).unionByName(children).unionByName(members))
    delete(spark, folder)
    return found


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's writes in turn: groups are appended twice over, a field is set, the last of each
    id counts, and a truncated table adds nothing."""
    groups = t_groups = tables(spark, sf_dir)["dsar"].withColumn("seq", F.lit(0))
    later = store.set_field(t_groups.where("created_by = 'AlignmentManager'"), "model_type", F.lit("written")).withColumn("seq", F.lit(1))
    rows = store.insert(store.insert(groups, later), store.truncate(later))
    return store.upsert(rows, ["dsar_id"], "seq").select("dsar_id", "created_by", "model_type")


def _stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node registry as a stored table: each stage upserts its edges' nodes, as the build goes."""
    graph, path = flow(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    table = BucketTable(spark, path, "node_id string, type string, node_type string, model_type string, seq long", ["node_id", "node_type"], 16)
    for stage in (1, 2, 3):
        end = lambda df, side, last: df.where(F.col("stage") == stage).select(F.col(side).alias("node_id"), F.col(f"{side}_kind").alias("type"), F.col(f"{side}_type").alias("node_type"), F.col(f"{side}_model").alias("model_type"), (F.col("edge_ord") * 2 + last).alias("seq"))
        table.upsert(end(graph.rows, "src", 0).unionByName(end(graph.edges, "dst", 1)), "seq")
    found = cut(table.read().drop("seq"))
    delete(spark, path)
    return found


def _stored_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes' edge lists as stored tables: each stage pushes its edges' names."""
    graph, path = flow(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/adjacency-{uuid.uuid4().hex}"
    name, keys, lists = F.concat(F.lit("e"), F.col("edge_ord").cast("string")).alias("name"), ["node_id", "node_type"], []
    for side, rows, column in (("src", graph.rows, "source_edge"), ("dst", graph.edges, "destination_edge")):
        table = BucketTable(spark, f"{path}/{side}", f"node_id string, node_type string, {column} array<string>", keys, 16)
        for stage in (1, 2, 3):
            own = rows.where(F.col("stage") == stage).select(F.col(side).alias("node_id"), F.col(f"{side}_type").alias("node_type"), "edge_ord", name)
            table.push(store.push(own, keys, "name", "edge_ord", column), column)
        lists.append(table.read())
    found = cut(lists[0].join(lists[1], keys, "full_outer").select(*keys, _joined(F.col("source_edge"), "source_edge"), _joined(F.col("destination_edge"), "destination_edge")))
    delete(spark, path)
    return found


def _by_node(of):
    """What incidences stored by node say."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with ByNode(flow(spark, sf_dir).rows) as stored:
            return cut(of(stored))

    return query


def last_window(t: documents.Tables) -> tuple[documents.Tables, documents.Tables]:
    """(before, change): the tables as they were before the records of the last window came, and all
    rows of the documents that came with them or that they changed: a record gains children when a
    later one takes it as a parent."""
    end = t["dsir"].agg(F.max("t_begin").alias("end"))
    late = cut(t["dsir"].join(F.broadcast(end), F.col("t_begin") == F.col("end")).select(F.col("dsir_id").alias("id")))  # end is one row
    names = lambda df, column: df.select(F.col(column).alias("id")).distinct()
    groups = names(t["dsar_dsir"].join(late.withColumnRenamed("id", "dsir_id"), "dsir_id", "left_semi"), "dsar_id")
    jobs = names(t["job"].join(late.withColumnRenamed("id", "output_dsir"), "output_dsir", "left_semi"), "job_id")
    parents = names(t["dsir_child"].join(late.withColumnRenamed("id", "child_id"), "child_id", "left_semi"), "dsir_id")
    new = {"dsir_id": late, "dsar_id": cut(groups), "job_id": cut(jobs)}
    changed = new | {"dsir_id": cut(late.unionByName(parents).distinct())}
    within = lambda df, ids, column, how: df.join(ids[column].withColumnRenamed("id", column), column, how)
    before = {name: within(df, new, OWNER[name], "left_anti").select(*df.columns) for name, df in t.items()}
    before["dsir_child"] = before["dsir_child"].join(late.withColumnRenamed("id", "child_id"), "child_id", "left_anti").select("dsir_id", "pos", "child_id")
    return before, {name: within(df, changed, OWNER[name], "left_semi").select(*df.columns) for name, df in t.items()}


def grown(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both graphs of a folder, stored as of the last window but one and brought up to date by the
    change that followed; once for a session and a state of the folder's files."""
    key = state(spark, sf_dir)
    if key not in _GROWN:
        _GROWN.clear()
        path = f"{shared_dir(spark).rstrip('/')}/graphs-{uuid.uuid4().hex}"
        before, change = last_window(tables(spark, sf_dir))
        graphs = delta.StoredGraphs(spark, path, 16)
        with Scratch(spark) as keep:
            graphs.build({name: keep(df) for name, df in before.items()})
        graphs.change(change)
        found = {name: stored(table.read()) for name, table in (("rows", graphs.rows), ("edges", graphs.edges), ("nodes", graphs.nodes))}
        found["links"] = model_graph.connected(stored(graphs.links.stubs()), stored(graphs.links.parents.read()))
        _GROWN[key] = found
        delete(spark, path)
    return _GROWN[key]


def _grown(name: str, *columns: str):
    return lambda spark, sf_dir: grown(spark, sf_dir)[name].select(*columns)


def _on_tables(of):
    return lambda spark, sf_dir: of(tables(spark, sf_dir))


def _on_rows(of):
    return lambda spark, sf_dir: of(flow(spark, sf_dir).rows)


def _stage(of):
    return _on_tables(lambda t: of(t).select("dst", "dst_type", "dst_model", "edge_type", "src", "src_type", "src_model", "pos", "weight"))


def _joined(array, name):
    return F.coalesce(F.array_join(array, ","), F.lit("")).alias(name)


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_json(model_graph.nodes(tables(spark, sf_dir)).select("dsir_id", "name", "t_begin", "t_end"))


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the models whose edge's first variable is chosen, for a choice that SQL can say
    too: every variable whose number is divisible by 3."""
    rows = flow(spark, sf_dir).rows
    return model_graph.optimal_path(tables(spark, sf_dir), program.variables(rows), rows.where("var_ord % 3 = 0").select("var_ord"))


def _optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow(spark, sf_dir).rows
    return model_graph.optimal_path(tables(spark, sf_dir), program.variables(rows), solved(spark, sf_dir))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow(spark, sf_dir).rows
    return drawing.edge_list(rows, rows.where("var_ord % 3 = 0").select("var_ord"))


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir).adjacency().select("node_id", "node_type", _joined(F.col("source_edge"), "source_edge"), _joined(F.col("destination_edge"), "destination_edge"))


#: Queries whose answer SQL cannot find. lp_certificate proves the choice that they share; tests hold
#: the choice against plain search on small programs, and the others against the choice.
NO_ORACLE = {"lp_first_optimum", "lp_optimum", "lp_second", "optimal_path", "service_answers", "viz_optimum"}

QUERIES = {
    # sources
    "build_all": _built,
    "documents_normalised": _normalised,
    "store_writes": _written,
    "store_registry": _stored_registry,
    "store_adjacency": _stored_adjacency,
    "scan_all": _on_tables(lambda t: store.find(t["dsir"])),
    "scan_filtered": _on_tables(lambda t: store.find(t["dsar"], {"created_by": "PostSynchronizationManager"}, ["dsar_id", "model_type"])),
    "scan_first_match": _on_tables(lambda t: store.find_first(t["dsir_parent"], ["dsir_id"], ["pos"])),
    "scan_nested_member": _on_rows(lambda r: store.find(r, {"src": "S0", "src_type": "am"}, ["edge_ord", "dst"])),
    "dangling_references": _on_tables(documents.validate),
    "json_nodes": _json,
    # model graph
    "mg_nodes": _on_tables(model_graph.nodes),
    "mg_suppressed": _on_tables(model_graph.suppressed),
    "mg_edges_jg": _on_tables(model_graph.edges_of_runs),
    "mg_edges_psm": _on_tables(model_graph.edges_of_results),
    "mg_edges": _on_tables(model_graph.edges),
    "mg_edge_counts": _on_tables(model_graph.edge_counts),
    "mg_graph": _on_tables(model_graph.graph_digests),
    # flow graph
    "fg_model_to_am": _stage(model_to_am),
    "fg_am_to_job": _stage(am_to_job),
    "fg_job_to_cluster": _stage(job_to_cluster),
    "fg_cluster_to_model": _stage(cluster_to_model),
    "fg_edges": _on_tables(lambda t: hyperedges(t).select("dst", "dst_type", "edge_type", "n_sources", "weight")),
    "fg_edge_names": lambda spark, sf_dir: flow(spark, sf_dir).names(),
    "fg_nodes": lambda spark, sf_dir: flow(spark, sf_dir).nodes(),
    "fg_adjacency": _adjacency,
    "fg_node_degree": lambda spark, sf_dir: flow(spark, sf_dir).degrees(),
    # incidences stored by node
    "by_node_bk": _by_node(lambda b: b.incoming_sums()),
    "by_node_fr": _by_node(lambda b: b.outgoing_sums()),
    "by_node_constraints": _by_node(lambda b: b.constraints()),
    "by_node_member": _by_node(lambda b: b.found("S0", "am", "src").select("edge_ord", "dst")),
    # both graphs after a change, kept up and not built anew
    "delta_incidences": _grown("rows", "stage", "dst", "dst_type", "dst_model", "edge_type", "src", "src_type", "src_model", "pos", "weight"),
    "delta_hyperedges": _grown("edges", "stage", "key", "kind", "nth", "dst", "dst_type", "edge_type", "n_sources", "weight"),
    "delta_nodes": _grown("nodes", "dsir_id", "name", "t_begin", "t_end"),
    "delta_connectors": _grown("links", "dsir_id", "connect_to", "pos1", "pos2", "pos3"),
    # traversal
    "timeline_sizes": lambda spark, sf_dir: timelines(spark, sf_dir).sizes(),
    "timeline_all_models": lambda spark, sf_dir: timelines(spark, sf_dir).models,
    "timeline_backward": lambda spark, sf_dir: timelines(spark, sf_dir).backward(BACK),
    "timeline_forward": lambda spark, sf_dir: timelines(spark, sf_dir).forward(AHEAD),
    "timeline": lambda spark, sf_dir: timelines(spark, sf_dir).timeline(MIDDLE),
    "timeline_models": lambda spark, sf_dir: timelines(spark, sf_dir).model_timeline(MIDDLE),
    "timeline_walk": _on_rows(lambda r: traverse.timeline(r, EARLY).select("node_id", "node_type", "direction")),
    "timeline_models_as_shipped": _on_rows(lambda r: traverse.model_timeline(r, EARLY, as_shipped=True)),
    "timeline_paths": _on_rows(lambda r: traverse.written_counts(traverse.path_counts(r, BACK, "model"))),
    "timeline_order": _on_rows(lambda r: traverse.backward_walk(r, *GROUP)),
    # selection program
    "lp_vars": _on_rows(lambda r: program.variables(r).select("var_name", "dst", "dst_type", "src", "src_type", "pos", "weight")),
    "lp_bk": _on_rows(program.incoming_sums),
    "lp_fr": _on_rows(program.outgoing_sums),
    "lp_constraints_exact": _on_rows(lambda r: program.constraints(r, "exact")),
    "lp_constraints_first": _on_rows(lambda r: program.constraints(r, "first")),
    "lp_constraint_names": _on_rows(lambda r: program.named_constraints(r)),
    "lp_sink": _on_rows(program.sink),
    "lp_objective": _on_rows(program.objective),
    "lp_mini_optimum": lambda spark, sf_dir: solver.solve(mini.rows(spark)),
    "lp_mini_optimum_first": lambda spark, sf_dir: solver.solve(mini.rows(spark), "first"),
    "lp_optimum": solved,
    "lp_optimum_equations": _equations,
    "lp_certificate": _proof,
    "lp_second": _second,
    "lp_second_equations": lambda spark, sf_dir: _equations(spark, sf_dir, _second),
    "lp_first_optimum": solved_first,
    "lp_first_equations": lambda spark, sf_dir: _equations(spark, sf_dir, solved_first, "first"),
    "optimal_path_dsirs": _path,
    "optimal_path": _optimal,
    # drawing
    "viz_edges": _on_rows(drawing.edge_list),
    "viz_optimal_edges": _drawn,
    "viz_optimum": lambda spark, sf_dir: drawing.edge_list(flow(spark, sf_dir).rows, solved(spark, sf_dir)),
    "viz_scenes": _on_rows(drawing.scenes),
    # service
    "service_answers": _answers,
    "service_model_graph": _answer_graph,
    "service_timeline": _answer_timeline,
}

# ---------------------------------------------------------------- DuckDB

_MG = """
kept AS (SELECT d.* FROM dsir d LEFT JOIN (SELECT c.dsir_id, x.created_by AS by_ FROM dsir_child c JOIN dsir x ON x.dsir_id = c.child_id WHERE c.pos = 0) f ON f.dsir_id = d.dsir_id
  WHERE d.created_by = 'PostSynchronizationManager' OR (d.created_by = 'JobGateway' AND coalesce(f.by_, '') <> 'PostSynchronizationManager')),
e2 AS (SELECT k.dsir_id, b.parent_id AS connect_to, a.pos AS pos1, b.pos AS pos2, -1 AS pos3 FROM kept k JOIN dsir_parent a ON a.dsir_id = k.dsir_id JOIN dsir_parent b ON b.dsir_id = a.parent_id WHERE k.created_by = 'JobGateway'),
e3 AS (SELECT k.dsir_id, c.parent_id AS connect_to, a.pos AS pos1, b.pos AS pos2, c.pos AS pos3 FROM kept k JOIN dsir_parent a ON a.dsir_id = k.dsir_id JOIN dsir_parent b ON b.dsir_id = a.parent_id JOIN dsir_parent c ON c.dsir_id = b.parent_id WHERE k.created_by = 'PostSynchronizationManager'),
mg AS (SELECT * FROM e2 UNION ALL SELECT * FROM e3)
"""

_W = "cast(cast(('0x' || substr(md5(concat({t}, '|', {d}, '|', {s}, '|', cast({p} AS string))), 1, 4)) AS int) AS double) / 65536"

_FG = f"""
s1 AS (SELECT 1 AS stage, g.dsar_id AS key, 0 AS kind, 0::BIGINT AS nth, g.dsar_id AS dst, 'dsar' AS dst_kind, 'am' AS dst_type, g.model_type AS dst_model, 'AND' AS edge_type,
  x.dsar_id AS src, 'dsar' AS src_kind, 'model' AS src_type, x.model_type AS src_model, l.pos AS pos, {_W.format(t="'am'", d="g.dsar_id", s="x.dsar_id", p="l.pos")} AS weight
  FROM dsar g JOIN dsar_dsir f ON f.dsar_id = g.dsar_id AND f.pos = 0 JOIN dsir_parent p ON p.dsir_id = f.dsir_id AND p.pos = 0 JOIN dsir o1 ON o1.dsir_id = p.parent_id
  JOIN dsar_dsir l ON l.dsar_id = o1.dsar_id JOIN dsir x ON x.dsir_id = l.dsir_id WHERE g.created_by = 'AlignmentManager'),
s2 AS (SELECT 2 AS stage, j.output_dsir AS key, 0 AS kind, j.job_id AS nth, j.output_dsir AS dst, 'dsir' AS dst_kind, 'job' AS dst_type, j.model_type AS dst_model, 'OR' AS edge_type,
  g.dsar_id AS src, 'dsar' AS src_kind, 'am' AS src_type, g.model_type AS src_model, i.pos AS pos, j.relevance AS weight FROM job j JOIN job_dsar i ON i.job_id = j.job_id JOIN dsar g ON g.dsar_id = i.dsar_id),
member AS (SELECT g.dsar_id, g.model_type AS group_model, l.pos AS nth, d.* EXCLUDE (dsar_id) FROM dsar g JOIN dsar_dsir l ON l.dsar_id = g.dsar_id JOIN dsir d ON d.dsir_id = l.dsir_id WHERE g.created_by = 'PostSynchronizationManager'),
fit AS (SELECT m.dsar_id, m.nth, m.dsir_id, m.model_type, r.dsir_id AS run, (row_number() OVER (PARTITION BY m.dsar_id, m.nth, m.dsir_id ORDER BY p.pos) - 1)::INT AS pos
  FROM member m JOIN dsir_parent p ON p.dsir_id = m.dsir_id JOIN dsir r ON r.dsir_id = p.parent_id AND r.created_by = 'JobGateway' AND r.t_begin = m.t_begin AND r.t_end = m.t_end AND r.model_type = m.model_type),
alone AS (SELECT * FROM fit UNION ALL SELECT dsar_id, nth, dsir_id, model_type, dsir_id, 0 FROM member WHERE dsir_id NOT IN (SELECT dsir_id FROM fit)),
s3 AS (SELECT 3 AS stage, dsar_id AS key, 0 AS kind, nth::BIGINT AS nth, dsir_id AS dst, 'dsir' AS dst_kind, 'cluster_aggr' AS dst_type, model_type AS dst_model, 'OR' AS edge_type,
  run AS src, 'dsir' AS src_kind, 'job' AS src_type, model_type AS src_model, pos, {_W.format(t="'cluster_aggr'", d="dsir_id", s="run", p="pos")} AS weight FROM alone),
s4 AS (SELECT 3 AS stage, dsar_id AS key, 1 AS kind, 0::BIGINT AS nth, dsar_id AS dst, 'dsar' AS dst_kind, 'model' AS dst_type, group_model AS dst_model, 'AND' AS edge_type,
  dsir_id AS src, 'dsir' AS src_kind, 'cluster_aggr' AS src_type, model_type AS src_model, nth AS pos, {_W.format(t="'model'", d="dsar_id", s="dsir_id", p="nth")} AS weight FROM member),
raw AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
hyper AS (SELECT stage, key, kind, nth, any_value(dst) AS dst, any_value(dst_kind) AS dst_kind, any_value(dst_type) AS dst_type, any_value(dst_model) AS dst_model, any_value(edge_type) AS edge_type, count(*) AS n_sources, sum(weight) AS weight FROM raw GROUP BY ALL
  UNION ALL SELECT 3, dsar_id, 1, 0, dsar_id, 'dsar', 'model', model_type, 'AND', 0, 0.0 FROM dsar WHERE created_by = 'PostSynchronizationManager' AND dsar_id NOT IN (SELECT dsar_id FROM dsar_dsir)),
edge AS (SELECT *, row_number() OVER (ORDER BY stage, key, kind, nth) - 1 AS edge_ord FROM hyper),
inc AS (SELECT r.*, e.edge_ord, row_number() OVER (ORDER BY e.edge_ord, r.pos) - 1 AS var_ord FROM raw r JOIN edge e USING (stage, key, kind, nth))
"""

_LP = """
bkv AS (SELECT dst AS node_id, dst_type AS node_type, var_ord, edge_type AS bt FROM inc JOIN (SELECT dst, dst_type, min(edge_ord) AS edge_ord FROM inc GROUP BY ALL) USING (dst, dst_type, edge_ord)),
bk AS (SELECT node_id, node_type, count(*) AS nb, any_value(bt) AS bt FROM bkv GROUP BY ALL),
frv AS (SELECT src AS node_id, src_type AS node_type, edge_ord, any_value(edge_type) AS edge_type, arg_min(var_ord, pos) AS var_ord FROM inc GROUP BY src, src_type, edge_ord),
frf AS (SELECT f.node_id, f.node_type, f.edge_ord, f.edge_type, i.var_ord FROM frv f JOIN inc i ON i.edge_ord = f.edge_ord AND i.pos = 0),
fr AS (SELECT node_id, node_type, count(*) AS nf, arg_min(edge_type, edge_ord) AS ft FROM frv GROUP BY ALL),
scale AS (SELECT node_id, node_type, CASE WHEN ft = 'AND' THEN nf ELSE 1 END AS s, CASE WHEN bt = 'AND' THEN nb ELSE 1 END AS o FROM bk JOIN fr USING (node_id, node_type)),
cex AS (SELECT node_id, node_type, var_ord, sum(coef)::BIGINT AS coef FROM (SELECT node_id, node_type, var_ord, s AS coef FROM bkv JOIN scale USING (node_id, node_type) UNION ALL SELECT node_id, node_type, var_ord, -o FROM frv JOIN scale USING (node_id, node_type)) GROUP BY ALL HAVING sum(coef) <> 0),
cfi AS (SELECT node_id, node_type, var_ord, sum(coef)::BIGINT AS coef FROM (SELECT node_id, node_type, var_ord, s AS coef FROM bkv JOIN scale USING (node_id, node_type) UNION ALL SELECT node_id, node_type, var_ord, -o FROM frf JOIN scale USING (node_id, node_type)) GROUP BY ALL HAVING sum(coef) <> 0),
snk AS (SELECT var_ord, count(*) AS coef FROM bkv WHERE node_type = 'model' AND (node_id, node_type) NOT IN (SELECT (node_id, node_type) FROM fr) GROUP BY var_ord),
cnm AS (SELECT node_id, node_type, row_number() OVER (ORDER BY node_id, node_type) - 1 AS ord FROM (SELECT DISTINCT node_id, node_type FROM cex))
"""

_LABELS = """
lab AS (SELECT var_ord, concat('e', var_ord) AS var_name, concat_ws('-', src_type, src_kind, right(src, 3)) AS src_label, concat_ws('-', dst_type, dst_kind, right(dst, 3)) AS dst_label FROM inc)
"""

_BASE = duckdb_tables()


def _sql(query: str, *parts: str) -> str:
    return f"WITH {', '.join([_BASE, *parts])} {query}"


def _reach(node_id: str, step: str, name: str) -> str:
    """A recursive term; a hyperedge is the point ('#', its number)."""
    return f"""{name} AS (SELECT '{node_id}' AS node_id, 'model' AS node_type UNION SELECT s.b, s.bt FROM {name} r JOIN {step} s ON s.a = r.node_id AND s.at_ = r.node_type)"""


_STEPS = """
behind AS (SELECT dst AS a, dst_type AS at_, src AS b, src_type AS bt FROM inc),
ahead AS (SELECT src AS a, src_type AS at_, cast(edge_ord AS string) AS b, '#' AS bt FROM inc UNION ALL SELECT cast(edge_ord AS string), '#', src, src_type FROM inc UNION ALL SELECT cast(edge_ord AS string), '#', dst, dst_type FROM inc)
"""


def _recursive(query: str, *parts: str) -> str:
    return "WITH RECURSIVE" + _sql(query, _FG, _STEPS, *parts).removeprefix("WITH")


def _paths(node_id: str, name: str, levels: int) -> str:
    """How many paths lead back to each node: level by level, for at most so many steps."""
    first = f"{name}0 AS (SELECT '{node_id}' AS node_id, 'model' AS node_type, 1::HUGEINT AS n)"
    more = (f"{name}{k} AS MATERIALIZED (SELECT s.b AS node_id, s.bt AS node_type, sum(p.n)::HUGEINT AS n FROM {name}{k - 1} p JOIN behind s ON s.a = p.node_id AND s.at_ = p.node_type GROUP BY ALL)" for k in range(1, levels + 1))
    every = " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(levels + 1))
    return ", ".join([first, *more, f"{name} AS (SELECT node_id, node_type, sum(n)::HUGEINT AS n FROM ({every}) GROUP BY ALL)"])


def _all(step: str, name: str) -> str:
    """What every model reaches, by its start."""
    return f"{name} AS (SELECT node_id AS start, node_id, 'model' AS node_type FROM (SELECT src AS node_id FROM inc WHERE src_type = 'model' UNION SELECT dst FROM inc WHERE dst_type = 'model') UNION SELECT r.start, s.b, s.bt FROM {name} r JOIN {step} s ON s.a = r.node_id AND s.at_ = r.node_type)"


_EVERY = (_all("behind", "rb"), _all("ahead", "rf"))
_EVERY_BOTH = "(SELECT start, node_id, node_type, 'backward' AS direction FROM rb WHERE NOT (node_id = start AND node_type = 'model') UNION ALL SELECT start, node_id, node_type, 'forward' FROM rf WHERE node_type <> '#')"
_TIMELINE = (_reach(MIDDLE, "behind", "rb"), _reach(MIDDLE, "ahead", "rf"))
_BOTH = f"""(SELECT node_id, node_type, 'backward' AS direction FROM rb WHERE NOT (node_id = '{MIDDLE}' AND node_type = 'model') UNION ALL SELECT node_id, node_type, 'forward' FROM rf WHERE node_type <> '#')"""
_STAGE = "SELECT dst, dst_type, dst_model, edge_type, src, src_type, src_model, pos, weight FROM "


def _mini(equations: list[dict[int, int]]) -> str:
    """All 2^15 choices, the feasible ones, the best, and of equals the smallest list."""
    bit = lambda v: f"((m >> {v}) & 1)"
    weights = [x[-1] for x in mini.incidences()]
    holds = " AND ".join("(" + " + ".join(f"{c} * {bit(v)}" for v, c in row.items()) + ") = 0" for row in equations)
    total = " + ".join(f"{w} * {bit(v)}" for v, w in enumerate(weights))
    picked = ", ".join(f"CASE WHEN {bit(v)} = 1 THEN '{chr(97 + v)}' ELSE '' END" for v in range(15))
    best = f"SELECT m, {total} AS total FROM (SELECT unnest(range(32768)) AS m) WHERE {holds} AND {bit(14)} = 1 ORDER BY total DESC, concat({picked}) LIMIT 1"
    return f"SELECT v AS var_ord, total::DOUBLE AS total FROM ({best}), (SELECT unnest(range(15)) AS v) WHERE ((m >> v) & 1) = 1"


#: The small program's equations by variable, exact, and those that differ in "first".
_COMMON = [{10: 1, 11: 1, 0: -2}, {0: 1, 1: 1, 5: -2, 6: -2}, {2: 1, 7: -1}, {4: 1, 9: -1}, {5: 1, 12: -1}, {7: 1, 8: 1, 10: -1}, {12: 1, 13: 1, 14: -1}]
_EXACT = [{3: 1, 8: -1}, {6: 1, 13: -1}, {9: 1, 11: -1}]
_FIRST = [{3: 1, 7: -1}, {6: 1, 12: -1}, {9: 1, 10: -1}]

_NODES = _sql(
    "SELECT node_id, arg_max(kind, seq) AS type, node_type, arg_max(model, seq) AS model_type FROM (SELECT src AS node_id, src_type AS node_type, src_kind AS kind, src_model AS model, edge_ord * 2 AS seq FROM inc UNION ALL SELECT dst, dst_type, dst_kind, dst_model, edge_ord * 2 + 1 FROM edge) GROUP BY node_id, node_type",
    _FG,
)
_LISTS = _sql(
    "SELECT node_id, node_type, coalesce(string_agg(concat('e', o), ',' ORDER BY o) FILTER (side = 0), '') AS source_edge, coalesce(string_agg(concat('e', o), ',' ORDER BY o) FILTER (side = 1), '') AS destination_edge FROM (SELECT src AS node_id, src_type AS node_type, edge_ord AS o, 0 AS side FROM inc UNION ALL SELECT dst, dst_type, edge_ord, 1 FROM edge) GROUP BY node_id, node_type",
    _FG,
)

ORACLES = {
    "store_registry": _NODES,
    "store_adjacency": _LISTS,
    "build_all": _sql(
        " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {cte}" for name, cte in (*((t, t) for t in ("dsir", "dsir_parent", "dsir_child", "dsar", "dsar_dsir", "job", "job_dsar")), ("hyperedges", "edge"), ("variables", "inc"))), _FG
    ),
    "documents_normalised": _sql(
        "SELECT j.output_dsir AS record, i.dsar_id AS other, i.pos, 'input' AS side FROM job j JOIN job_dsar i USING (job_id) UNION ALL SELECT dsir_id, parent_id, pos, 'parent' FROM dsir_parent"
        " UNION ALL SELECT dsir_id, child_id, pos, 'child' FROM dsir_child UNION ALL SELECT dsar_id, dsir_id, pos, 'member' FROM dsar_dsir"
    ),
    "store_writes": _sql("SELECT dsar_id, created_by, CASE WHEN created_by = 'AlignmentManager' THEN 'written' ELSE model_type END AS model_type FROM dsar"),
    "scan_all": _sql("SELECT dsir_id, created_by, model_type, t_begin, t_end, dsar_id FROM dsir"),
    "scan_filtered": _sql("SELECT dsar_id, model_type FROM dsar WHERE created_by = 'PostSynchronizationManager'"),
    "scan_first_match": _sql("SELECT dsir_id, pos, parent_id FROM dsir_parent QUALIFY row_number() OVER (PARTITION BY dsir_id ORDER BY pos) = 1"),
    "scan_nested_member": _sql("SELECT edge_ord, dst FROM inc WHERE src = 'S0' AND src_type = 'am'", _FG),
    "dangling_references": _sql(
        "SELECT 'dsir_parent' AS table_name, 'parent_id' AS column_name, parent_id AS missing_id, count(*) AS n FROM dsir_parent WHERE parent_id NOT IN (SELECT dsir_id FROM dsir) GROUP BY ALL"
        " UNION ALL SELECT 'job_dsar', 'dsar_id', dsar_id, count(*) FROM job_dsar WHERE dsar_id NOT IN (SELECT dsar_id FROM dsar) GROUP BY ALL"
        " UNION ALL SELECT 'dsir_child', 'child_id', child_id, count(*) FROM dsir_child WHERE child_id NOT IN (SELECT dsir_id FROM dsir) GROUP BY ALL"
        " UNION ALL SELECT 'dsar_dsir', 'dsir_id', dsir_id, count(*) FROM dsar_dsir WHERE dsir_id NOT IN (SELECT dsir_id FROM dsir) GROUP BY ALL"
        " UNION ALL SELECT 'job', 'output_dsir', output_dsir, count(*) FROM job WHERE output_dsir NOT IN (SELECT dsir_id FROM dsir) GROUP BY ALL"
        " UNION ALL SELECT 'dsir', 'dsar_id', dsar_id, count(*) FROM dsir WHERE dsar_id NOT IN (SELECT dsar_id FROM dsar) GROUP BY ALL"
    ),
    "json_nodes": _sql("""SELECT concat('{"dsir_id":"', dsir_id, '","name":"', model_type, '","t_begin":', t_begin, ',"t_end":', t_end, '}') AS json FROM kept""", _MG),
    "mg_nodes": _sql("SELECT dsir_id, model_type AS name, t_begin, t_end FROM kept", _MG),
    "mg_suppressed": _sql("SELECT dsir_id FROM dsir WHERE created_by = 'JobGateway' AND dsir_id NOT IN (SELECT dsir_id FROM kept)", _MG),
    "mg_edges_jg": _sql("SELECT * FROM e2", _MG),
    "mg_edges_psm": _sql("SELECT * FROM e3", _MG),
    "mg_edges": _sql("SELECT * FROM mg", _MG),
    "mg_edge_counts": _sql("SELECT dsir_id, connect_to, count(*) AS n FROM mg GROUP BY ALL", _MG),
    "mg_graph": _sql(
        "SELECT k.model_type AS name, k.dsir_id AS id, k.t_begin, k.t_end, md5(coalesce(l.c, '')) AS connectors, coalesce(l.n, 0) AS n_connectors FROM kept k LEFT JOIN (SELECT dsir_id, string_agg(concat('start-finish:', connect_to), ',' ORDER BY pos1, pos2, pos3, connect_to) AS c, count(*) AS n FROM mg GROUP BY dsir_id) l ON l.dsir_id = k.dsir_id",
        _MG,
    ),
    "fg_model_to_am": _sql(_STAGE + "s1", _FG),
    "fg_am_to_job": _sql(_STAGE + "s2", _FG),
    "fg_job_to_cluster": _sql(_STAGE + "s3", _FG),
    "fg_cluster_to_model": _sql(_STAGE + "s4", _FG),
    "fg_edges": _sql("SELECT dst, dst_type, edge_type, n_sources, weight FROM hyper", _FG),
    "fg_edge_names": _sql("SELECT concat('e', edge_ord) AS edge_name, dst, dst_type, edge_type, n_sources FROM edge", _FG),
    "fg_nodes": _NODES,
    "fg_adjacency": _LISTS,
    "fg_node_degree": _sql(
        "SELECT node_id, node_type, count(*) FILTER (side = 0) AS n_out, count(*) FILTER (side = 1) AS n_in FROM (SELECT src AS node_id, src_type AS node_type, 0 AS side FROM inc UNION ALL SELECT dst, dst_type, 1 FROM edge) GROUP BY node_id, node_type",
        _FG,
    ),
    "by_node_bk": _sql("SELECT node_id, node_type, nb, bt FROM bk", _FG, _LP),
    "by_node_fr": _sql("SELECT node_id, node_type, nf, ft FROM fr", _FG, _LP),
    "by_node_constraints": _sql("SELECT * FROM cex", _FG, _LP),
    "by_node_member": _sql("SELECT edge_ord, dst FROM inc WHERE src = 'S0' AND src_type = 'am'", _FG),
    "delta_incidences": _sql("SELECT stage, dst, dst_type, dst_model, edge_type, src, src_type, src_model, pos, weight FROM raw", _FG),
    "delta_hyperedges": _sql("SELECT stage, key, kind, nth, dst, dst_type, edge_type, n_sources, weight FROM hyper", _FG),
    "delta_nodes": _sql("SELECT dsir_id, model_type AS name, t_begin, t_end FROM kept", _MG),
    "delta_connectors": _sql("SELECT * FROM mg", _MG),
    "timeline_backward": _recursive("SELECT node_id, node_type FROM r", _reach(BACK, "behind", "r")),
    "timeline_forward": _recursive("SELECT node_id, node_type FROM r WHERE node_type <> '#'", _reach(AHEAD, "ahead", "r")),
    "timeline_sizes": _recursive(f"SELECT start, direction, count(*) AS n_nodes FROM {_EVERY_BOTH} GROUP BY ALL UNION ALL SELECT start, 'backward', 0 FROM rb GROUP BY start HAVING count(*) = 1", *_EVERY),
    "timeline_all_models": _recursive(f"SELECT start, node_id, direction FROM {_EVERY_BOTH} WHERE node_type = 'model'", *_EVERY),
    "timeline_walk": _recursive("SELECT node_id, node_type, direction FROM " + _BOTH.replace(MIDDLE, EARLY), _reach(EARLY, "behind", "rb"), _reach(EARLY, "ahead", "rf")),
    "timeline": _recursive(f"SELECT node_id, node_type, direction FROM {_BOTH}", *_TIMELINE),
    "timeline_models": _recursive(f"SELECT node_id FROM {_BOTH} WHERE node_type = 'model'", *_TIMELINE),
    "timeline_models_as_shipped": _recursive(
        f"SELECT '{EARLY}' AS node_id FROM (SELECT unnest(range(n::BIGINT)) FROM q WHERE node_type = 'model' AND node_id <> '{EARLY}' UNION ALL SELECT 1 FROM r WHERE node_type = 'model')",
        _paths(EARLY, "q", 40), _reach(EARLY, "ahead", "r"),
    ),
    "timeline_paths": _recursive("SELECT node_id, node_type, n::VARCHAR AS n_paths FROM q", _paths(BACK, "q", 40)),
    # a walk's order is that of its paths' variables, a path before those that go on from it
    "timeline_order": _recursive(
        "SELECT row_number() OVER (ORDER BY path) - 1 AS ordinal, node_id, node_type FROM w",
        f"w AS (SELECT '{GROUP[0]}' AS node_id, '{GROUP[1]}' AS node_type, []::BIGINT[] AS path UNION ALL SELECT i.src, i.src_type, list_append(w.path, i.var_ord) FROM w JOIN inc i ON i.dst = w.node_id AND i.dst_type = w.node_type)",
    ),
    "lp_vars": _sql("SELECT concat('e', var_ord) AS var_name, dst, dst_type, src, src_type, pos, weight FROM inc", _FG),
    "lp_bk": _sql("SELECT node_id, node_type, nb, bt FROM bk", _FG, _LP),
    "lp_fr": _sql("SELECT node_id, node_type, nf, ft FROM fr", _FG, _LP),
    "lp_constraints_exact": _sql("SELECT * FROM cex", _FG, _LP),
    "lp_constraints_first": _sql("SELECT * FROM cfi", _FG, _LP),
    "lp_constraint_names": _sql(
        "SELECT concat('c', n.ord) AS \"constraint\", c.var_ord, c.coef, 0 AS rhs FROM cex c JOIN cnm n USING (node_id, node_type) UNION ALL SELECT concat('c', (SELECT count(*) FROM cnm)), var_ord, coef, 1 FROM snk", _FG, _LP
    ),
    "lp_sink": _sql("SELECT var_ord, coef FROM snk", _FG, _LP),
    "lp_objective": _sql("SELECT var_ord, weight FROM inc", _FG),
    "lp_optimum_equations": _sql("SELECT DISTINCT node_id, node_type, 0::BIGINT AS value FROM cex UNION ALL SELECT 'sink', '', 1", _FG, _LP),
    "lp_second_equations": _sql("SELECT DISTINCT node_id, node_type, 0::BIGINT AS value FROM cex UNION ALL SELECT 'sink', '', 1", _FG, _LP),
    "lp_first_equations": _sql("SELECT DISTINCT node_id, node_type, 0::BIGINT AS value FROM cfi UNION ALL SELECT 'sink', '', 1", _FG, _LP),
    "lp_certificate": _sql("SELECT var_ord, 0.0::DOUBLE AS violation, 0.0::DOUBLE AS gap FROM inc", _FG),
    "service_model_graph": _sql(
        """SELECT concat('{"name":"', k.model_type, '","periods":[{"id":"', k.dsir_id, '","start":', k.t_begin, ',"end":', k.t_end, ',"connector":[', coalesce(l.c, ''), ']}]}') AS json FROM kept k LEFT JOIN (SELECT dsir_id, string_agg(concat('{"connectTo":"', connect_to, '","connectorType":"start-finish"}'), ',' ORDER BY pos1, pos2, pos3, connect_to) AS c FROM mg GROUP BY dsir_id) l ON l.dsir_id = k.dsir_id""",
        _MG,
    ),
    "service_timeline": _recursive(f"""SELECT concat('{{"node_id":"', node_id, '"}}') AS json FROM {_BOTH} WHERE node_type = 'model'""", *_TIMELINE),
    "lp_mini_optimum": _mini([*_COMMON, *_EXACT]),
    "lp_mini_optimum_first": _mini([*_COMMON, *_FIRST]),
    "optimal_path_dsirs": _sql("SELECT i.edge_ord, l.pos, l.dsir_id FROM inc i JOIN dsar_dsir l ON l.dsar_id = i.dst WHERE i.dst_type = 'model' AND i.pos = 0 AND i.var_ord % 3 = 0", _FG),
    "viz_edges": _sql("SELECT least(src_label, dst_label) AS a, greatest(src_label, dst_label) AS b, arg_max(var_name, var_ord) AS var_name, 'g' AS colour FROM lab GROUP BY 1, 2", _FG, _LABELS),
    "viz_optimal_edges": _sql(
        "SELECT least(src_label, dst_label) AS a, greatest(src_label, dst_label) AS b, arg_max(var_name, var_ord) AS var_name, arg_max(CASE WHEN var_ord % 3 = 0 THEN 'r' ELSE 'g' END, var_ord) AS colour FROM lab GROUP BY 1, 2",
        _FG, _LABELS,
    ),
    "viz_scenes": _sql("SELECT var_name, src_label, dst_label FROM lab", _FG, _LABELS),
}
