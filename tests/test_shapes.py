"""Hand-made provenance for shapes that the derived tables never have."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.operators import model_graph, program, solver, traverse
from tracewright.operators.flow_graph import FlowGraph, hyperedges, job_to_cluster, model_to_am
from tracewright.plans.api import Engine
from tracewright.sources import documents, mini, store
from tracewright.sources.schema import DSAR_DOC, DSIR_DOC, JOB_DOC

JG, PSM, AM = "JobGateway", "PostSynchronizationManager", "AlignmentManager"


def record(name, by, parents=(), children=None, dsar=None, model="m", begin=0, end=1):
    return {"_id": name, "created_by": by, "metadata": {"model_type": model, "temporal": {"begin": begin, "end": end}}, "parents": list(parents), "children": children, "dsar": dsar}


def group(name, by, members, model="m"):
    return {"_id": name, "created_by": by, "metadata": {"model_type": model}, "dsir_list": list(members)}


def tables(spark, records=(), groups=(), jobs=()):
    return documents.normalise(spark.createDataFrame(list(records), DSIR_DOC), spark.createDataFrame(list(groups), DSAR_DOC), spark.createDataFrame(list(jobs), JOB_DOC))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_which_runs_are_nodes(spark):
    t = tables(
        spark,
        [
            record("alone", JG), record("h2", JG, children=["x", "y"]), record("h3", JG, children=[]), record("hid", JG, children=["y"]),
            record("lost", JG, children=["nowhere"]), record("x", AM), record("y", PSM),
        ],
    )
    assert rows(model_graph.nodes(t), "dsir_id") == [("alone",), ("h2",), ("h3",), ("lost",), ("y",)]
    assert rows(model_graph.suppressed(t), "dsir_id") == [("hid",)]
    graph = {r["periods"][0]["id"]: r["periods"][0]["connector"] for r in model_graph.graph(t).collect()}
    assert graph["alone"] == []


def test_connectors_are_a_bag_in_order(spark):
    t = tables(spark, [record("j", JG, ["p", "q"]), record("p", AM, ["g", "h"]), record("q", AM, ["g", "gone"]), record("g", PSM), record("h", PSM)])
    assert rows(model_graph.edges_of_runs(t), "pos1", "pos2", "connect_to") == [(0, 0, "g"), (0, 1, "h"), (1, 0, "g"), (1, 1, "gone")]
    assert rows(model_graph.edge_counts(t).where("dsir_id = 'j'"), "connect_to", "n") == [("g", 2), ("gone", 1), ("h", 1)]
    graph = {r["periods"][0]["id"]: r["periods"][0] for r in model_graph.graph(t).collect()}
    assert [c["connectTo"] for c in graph["j"]["connector"]] == ["g", "h", "g", "gone"]
    assert {c["connectorType"] for c in graph["j"]["connector"]} == {"start-finish"}


def test_stand_in_run_and_empty_group(spark):
    t = tables(
        spark,
        [
            record("d", PSM, ["a", "b", "c", "o"], dsar="g"), record("a", JG, begin=5), record("b", JG, end=9), record("c", JG, model="other"), record("o", AM),
            record("e", PSM, ["bad", "k1", "k2"], dsar="g"), record("bad", JG, begin=7), record("k1", JG), record("k2", JG),
        ],
        [group("g", PSM, ["d", "e"]), group("none", PSM, [])],
    )
    assert rows(job_to_cluster(t), "dst", "src", "pos") == [("d", "d", 0), ("e", "k1", 0), ("e", "k2", 1)]
    assert rows(hyperedges(t).where("n_sources = 0"), "dst", "dst_type", "edge_type") == [("none", "model", "AND")]
    flow = FlowGraph(t)
    assert rows(flow.names().where("dst = 'none'"), "n_sources") == [(0,)]
    chosen = flow.rows.select("var_ord")
    assert ("none",) not in rows(model_graph.optimal_path(t, program.variables(flow.rows), chosen), "dsir_id")


def test_group_over_two_windows(spark):
    t = tables(
        spark,
        [record("a", AM, ["w"], dsar="s"), record("w", "WindowManager", dsar="wg"), record("p1", PSM, dsar="m1"), record("p2", PSM, dsar="m2", begin=1, end=2)],
        [group("s", AM, ["a"]), group("wg", "WindowManager", ["p1", "p2"]), group("m1", PSM, ["p1"]), group("m2", PSM, ["p2"]), group("s0", AM, [], "undefined")],
    )
    assert rows(model_to_am(t), "src", "dst", "pos") == [("m1", "s", 0), ("m2", "s", 1)]


def test_forward_ends_on_edges_with_several_sources(spark):
    small = spark.createDataFrame(mini.incidences([("AND", ["A", "B"], "S", "am", [0.5, 0.5]), ("OR", ["S"], "J", "job", [1.0])]), mini.SCHEMA)
    assert rows(traverse.forward(small, "A", "model"), "node_id", "depth") == [("A", 0), ("B", 1), ("J", 2), ("S", 1)]
    assert rows(traverse.backward(small, "J", "job"), "node_id") == [("A",), ("B",), ("J",), ("S",)]
    assert rows(traverse.model_timeline(small, "A"), "node_id") == [("A",), ("B",)]
    assert rows(traverse.model_timeline(small, "A", as_shipped=True), "node_id") == [("A",), ("A",)]
    assert rows(traverse.timeline(small, "absent"), "node_id", "direction") == [("absent", "forward")]


def test_paths_are_counted_as_a_walk_meets_them(spark):
    layers = [["M"], ["C1", "C2"], ["J1", "J2", "J3"], ["S"], ["N"], ["D"], ["K"], ["T"], ["O"]]
    kinds = ["model", "cluster_aggr", "job", "am"] * 2 + ["model"]
    edges = [("AND" if k % 2 else "OR", layers[k + 1], x, kinds[k], [1.0] * len(layers[k + 1])) for k in range(len(layers) - 1) for x in layers[k]]
    small = spark.createDataFrame(mini.incidences(edges + [("OR", ["J1", "J1"], "C2", "cluster_aggr", [1.0, 1.0])]), mini.SCHEMA)
    sources = {}
    for r in small.collect():
        sources.setdefault((r["dst"], r["dst_type"]), []).append((r["src"], r["src_type"]))

    def walk(node):
        return [node, *(x for s in sources.get(node, []) for x in walk(s))]

    met = Counter(walk(("M", "model")))
    assert met["O", "model"] == 8
    assert rows(traverse.backward_paths(small, "M", "model"), "node_id", "node_type", "n_paths") == sorted((*k, n) for k, n in met.items())
    assert len(rows(traverse.model_timeline(small, "M", as_shipped=True), "node_id")) == sum(n for (_, kind), n in met.items() if kind == "model")
    assert rows(traverse.backward_paths(small, "absent", "model"), "node_id", "n_paths") == [("absent", 1)]
    ordered = {}
    for r in small.orderBy("var_ord").collect():
        ordered.setdefault((r["dst"], r["dst_type"]), []).append((r["src"], r["src_type"]))
    sources = ordered
    assert rows(traverse.backward_walk(small, "M", "model"), "ordinal", "node_id", "node_type") == [(k, *x) for k, x in enumerate(walk(("M", "model")))]
    assert rows(traverse.backward_walk(small, "absent", "model"), "ordinal", "node_id") == [(0, "absent")]
    ring = spark.createDataFrame(mini.incidences([("AND", ["A"], "S", "am", [0.5]), ("OR", ["S"], "J", "job", [1.0]), ("OR", ["J"], "C", "cluster_aggr", [1.0]), ("AND", ["C"], "A", "model", [1.0])]), mini.SCHEMA)
    with pytest.raises(ValueError, match="cycle"):
        traverse.backward_walk(ring, "J", "job")


def test_dangling_references_are_reported(spark):
    t = tables(spark, [record("a", JG, ["gone"], dsar="lost")], [group("g", PSM, ["void"])], [{"_id": "r", "input_dsars": ["g", "nil"], "output_dsir": "zip", "model_type": "m", "relevance": 0.5}])
    assert rows(documents.validate(t), "table_name", "missing_id") == [("dsar_dsir", "void"), ("dsir", "lost"), ("dsir_parent", "gone"), ("job", "zip"), ("job_dsar", "nil")]


def test_small_optimum(spark):
    small = mini.rows(spark)
    found = solver.solve(small).collect()
    assert {r["total"] for r in found} == {5.75}
    assert sorted(r["var_ord"] for r in found) == [0, 1, 3, 4, 5, 8, 9, 10, 11, 12, 14]
    assert sorted(r["var_ord"] for r in solver.solve(small, "first").collect()) == [13, 14]
    with pytest.raises(ValueError, match="no sink"):
        solver.solve(spark.createDataFrame(mini.incidences([("AND", ["M"], "S", "am", [1.0]), ("OR", ["S"], "J", "job", [1.0]), ("OR", ["J"], "C", "cluster_aggr", [1.0]), ("AND", ["C"], "M", "model", [1.0])]), mini.SCHEMA))
    with pytest.raises(Exception, match="over the limit"):
        solver.solve(small, max_vars=3).collect()


def test_search_against_all_choices():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 10)
        equations = []
        for _ in range(rng.randint(0, 4)):
            equations.append(({v: rng.choice([-2, -1, 1, 2]) for v in rng.sample(range(n), rng.randint(1, min(4, n)))}, rng.choice([0, 0, 0, 1])))
        weights = [rng.randint(0, 8) / 8 for _ in range(n)]
        best = None
        for x in itertools.product((0, 1), repeat=n):
            if all(sum(c * x[v] for v, c in row.items()) == rhs for row, rhs in equations):
                got = (sum(w for w, y in zip(weights, x, strict=True) if y), [k for k in range(n) if x[k]])
                if best is None or got[0] > best[0] or (got[0] == best[0] and got[1] < best[1]):
                    best = got
        assert solver._search(weights, equations) == best


def layered(rng):
    """A small program with the layers of a flow graph, without cycles."""
    weights, rows, into, sink = [], [], [], {}

    def var():
        weights.append(rng.randint(0, 64) / 64)
        return len(weights) - 1

    clusters = [[] for _ in range(rng.randint(1, 3))]
    for _ in range(rng.randint(1, 3)):
        free = rng.random() < 0.4
        out = [var() for _ in range(rng.randint(1, 3))]
        for o in out:
            if rng.random() < 0.6:
                x = var()
                clusters[rng.randrange(len(clusters)) if free or len(clusters) == 1 else rng.randrange(1, len(clusters))].append(x)
                rows.append({o: 1, x: -1})
        if not free:
            a, b = var(), var()
            rows.append({a: 1, b: 1, **dict.fromkeys(out, -2)})
            into.append(a)
    made = []
    for c in clusters:
        if c:
            made.append(var())
            rows.append({**dict.fromkeys(c, 1), made[-1]: -1})
    k = min(1, len(made)) if clusters[0] else 0
    if k and into:
        rows.append({made[0]: len(into), **dict.fromkeys(into, -1)})
    return weights, rows, dict.fromkeys(made[k:], 1)


def test_networks_against_search():
    from tracewright.operators.network import heaviest

    rng, compared = random.Random(7), 0
    for k in range(900):
        weights, rows, sink = layered(rng)
        weights = [w if k % 3 == 0 else round(w * (k % 3)) / 2 for w in weights]  # few values, many ties
        for units in (0, 1) if sink else (0,):
            found = heaviest(weights, rows, sink, units)
            if found is None or len(weights) > 16:
                continue
            best = solver._search(weights, [*((r, 0) for r in rows), *([(sink, units)] if sink else [])])
            assert (best is None) == (found is False)
            if found:
                assert found == best and found[0] == sum(weights[v] for v in found[1])
                assert all(sum(c * (v in found[1]) for v, c in r.items()) == 0 for r in rows)
                compared += 1
    assert compared > 300


def test_any_network_against_search():
    from tracewright.operators.network import heaviest

    rng, compared = random.Random(11), Counter()
    for _ in range(1500):
        n = rng.randint(1, 6)
        rows, weights, sink = [{} for _ in range(n)], [], {}
        for v in range(rng.randint(1, 13)):
            a, b = sorted(rng.sample(range(-1, n + 1), 2))
            weights.append(rng.randint(0, rng.choice([1, 4, 64])) / 64)
            if a >= 0:
                rows[a][v] = -1
            if b < n:
                rows[b][v] = 1
            elif rng.random() < 0.3:
                sink[v] = 1
        rows = [r for r in rows if r]
        rng.shuffle(rows)
        for units in (0, 1) if sink else (0,):
            found = heaviest(weights, rows, sink, units)
            best = solver._search(weights, [*((r, 0) for r in rows), *([(sink, units)] if sink else [])])
            assert found is not None and (found or None) == best
            compared[units, best is None] += 1
    assert min(compared[0, False], compared[1, False], compared[1, True]) > 100


def decimal_network(rng, n_vars, cycles):
    """A network with weights that are no binary fractions: (weights, rows, sink)."""
    n = rng.randint(1, 6)
    rows, weights, sink = [{} for _ in range(n)], [], {}
    for v in range(rng.randint(1, n_vars)):
        a, b = rng.sample(range(-1, n + 1), 2) if cycles else sorted(rng.sample(range(-1, n + 1), 2))
        if cycles and (a == n or b == -1):
            a, b = b, a
        weights.append(rng.choice([rng.randint(0, 9) / 10, rng.random(), rng.randint(0, 4) / 4, 1e-3 * rng.randint(0, 9)]))
        if a >= 0:
            rows[a][v] = -1
        if b < n:
            rows[b][v] = 1
        elif rng.random() < 0.3:
            sink[v] = 1
    return weights, [r for r in rows if r], sink


def test_networks_of_any_weights_against_search():
    from tracewright.operators.network import heaviest, whole

    once = heaviest([0.2, 0.2, 0.2, 0.7, 0.1, 0.3, 0.1, 0.7, 0.2, 0.1, 0.3, 0.2], [{0: -1, 1: 1, 2: -1, 3: -1, 4: 1, 5: -1, 6: -1, 7: -1, 9: 1, 10: 1, 11: -1}], {3: 1, 8: 1}, 0)
    assert round(once[0], 9) == 2.1
    rng, compared = random.Random(11), Counter()
    for k in range(3000):
        weights, rows, sink = decimal_network(rng, 12, k % 3 == 0)
        exact, shift = whole(weights)
        for units in (0, 1) if sink else (0,):
            best = solver._search(exact, [*((r, 0) for r in rows), *([(sink, units)] if sink else [])])
            found = heaviest(weights, rows, sink, units)
            assert (found or None) == (None if best is None else (best[0] / (1 << shift), best[1]))
            compared[units, best is None, k % 3 == 0] += 1
    assert min(compared.values()) > 100


def all_choices(weights, rows):
    """(total, chosen) of every feasible choice, the best first."""
    n = len(weights)
    found = [[k for k in range(n) if x[k]] for x in itertools.product((0, 1), repeat=n) if all(sum(c * x[v] for v, c in r.items()) == rhs for r, rhs in rows)]
    return sorted(((sum(weights[v] for v in c), c) for c in found), key=lambda t: (-t[0], t[1]))


def test_next_flow_against_all_choices():
    import numpy as np

    from tracewright.operators import network

    rng, compared = random.Random(3), 0
    for k in range(400):
        weights, rows, sink = decimal_network(rng, 9, k % 3 == 0)
        exact, _ = network.whole(weights)
        tail, head, w, members, n = network.arcs(exact, rows, {})
        used = network.flow(tail, head, w, n, 0)
        found = network.cheapest_turn(tail, head, w, n, used, network.potentials(tail, head, w, n, used))
        every = all_choices(exact, [(r, 0) for r in rows])
        assert len(members) == len(weights) and (found is None) == (len(every) == 1)
        if found:
            used[found[1]] ^= True
            assert every[0][0] - found[0] == every[1][0] and (every[1][0], [v for v in range(len(weights)) if used[v]]) in every
            compared += 1
        part = solver.next_choice(exact, [(r, 0) for r in rows], every[0][1])
        assert part == (every[1] if len(every) > 1 else None)
    assert compared > 200


def test_second_of_the_small_program(spark):
    small = mini.rows(spark)
    found = solver.solution(small, second=True)
    terms = {}
    for r in program.constraints(small).collect():
        terms.setdefault((r["node_id"], r["node_type"]), {})[r["var_ord"]] = r["coef"]
    sink = {r["var_ord"]: r["coef"] for r in program.sink(small).collect()}
    weights = [r["weight"] for r in sorted(program.objective(small).collect(), key=lambda r: r["var_ord"])]
    every = all_choices(weights, [*((r, 0) for r in terms.values()), (sink, 1)])
    assert (found.total, sorted(r[0] for r in found.chosen.collect())) == every[0]
    assert (found.second_exact / 2**found.shift, sorted(r[0] for r in found.second.collect())) == every[1]


@pytest.mark.parametrize(("seed", "enough"), [(1, 2), (2, 1000), (3, 2), (4, 1000)])
def test_contracted_programs_against_search(spark, seed, enough):
    """Whole programs as tables, contracted and dealt by component, against plain search; proof and
    bound on what a task gets."""
    from tracewright.operators.network import whole

    rng = random.Random(seed)
    weights, equations, ends = [], [], {}
    while not ends or len(weights) < 15:
        w, rows, sink = decimal_network(rng, 5, seed == 3)
        at = len(weights)
        equations += [{v + at: c for v, c in r.items()} for r in rows]
        ends |= {v + at: 1 for v in sink}
        weights += [rng.choice([0.0, 0.5, x]) if seed % 2 else x for x in w]
    # a chain of two variables that an equation makes equal, and one in no equation
    n = len(weights)
    weights += [0.3, 0.1, 0.7, 0.2]
    equations += [{n: 1, n + 1: 1, n + 2: -2}]
    exact, shift = whole(weights)
    best = solver._search(exact, [*((r, 0) for r in equations), (ends, 1)])
    w = spark.createDataFrame(list(enumerate(weights)), "var_ord long, weight double")
    e = spark.createDataFrame([(f"n{k}", "t", v, c) for k, r in enumerate(equations) for v, c in r.items()], "node_id string, node_type string, var_ord long, coef long")
    s = spark.createDataFrame(list(ends.items()), "var_ord long, coef long")
    if best is None:
        with pytest.raises(ValueError, match="no feasible"):
            solver.solve_program(w, e, s, enough=enough)
        return
    found = solver.solve_program(w, e, s, enough=enough, second=True)
    other = sorted(r["var_ord"] for r in found.second.collect())
    chosen = set(other)
    assert other != best[1] and found.second_exact == sum(exact[v] for v in other)
    assert all(sum(c for v, c in r.items() if v in chosen) == 0 for r in equations) and sum(c for v, c in ends.items() if v in chosen) == 1
    assert found.second_exact == solver.next_choice(exact, [*((r, 0) for r in equations), (ends, 1)], best[1])[0]
    assert (found.exact, sorted(r["var_ord"] for r in found.chosen.collect())) == best
    assert found.total == best[0] / (1 << shift)
    assert rows_of(solver.certificate(found, w, e, s)) == {(0.0, 0.0)}
    assert found.most_arcs <= (len(weights) if enough == 1000 else 8)


def rows_of(df):
    return {(r["violation"], r["gap"]) for r in df.collect()}


def test_long_chains_and_parallel_arcs_leave_tasks_few_rows(spark):
    from pyspark.sql import functions as F

    # three chains of 40 nodes; every tenth step is a choice of three arcs
    arcs = spark.range(360).select(F.col("id").alias("var_ord"), (F.col("id") % 3).alias("copy"), F.floor(F.col("id") / 3).alias("at"))
    arcs = arcs.withColumns({"chain": F.floor(F.col("at") / 40), "step": F.col("at") % 40}).where("copy = 0 or step % 10 = 5").cache()
    w = arcs.select("var_ord", ((F.hash("var_ord") % 1000 + 1000) / 1000.0).alias("weight"))
    into = arcs.where("step < 39").select(F.concat_ws("-", "chain", "step").alias("node_id"), F.lit("t").alias("node_type"), "var_ord", F.lit(1).alias("coef"))
    out = arcs.where("step > 0").select(F.concat_ws("-", "chain", F.col("step") - 1).alias("node_id"), F.lit("t").alias("node_type"), "var_ord", F.lit(-1).alias("coef"))
    s = arcs.where("step = 39 and chain = 1").select("var_ord", F.lit(1).alias("coef"))
    e = into.unionByName(out)
    found = solver.solve_program(w, e, s, enough=30)
    best = arcs.join(w, "var_ord").groupBy("chain", "step").agg(F.max("weight").alias("m")).agg(F.sum("m")).first()[0]
    assert abs(found.total - best) < 1e-9 and found.chosen.count() == 120 and found.most_arcs <= 30
    assert rows_of(solver.certificate(found, w, e, s)) == {(0.0, 0.0)}


def test_index_of_timelines_is_the_walk_from_every_node(spark):
    """Random hypergraphs, cycles and repeated sources among them."""
    from tracewright.operators.reach import Timelines

    rng = random.Random(6)
    for cycles in (False, True):
        edges = []
        for k in range(14):
            sources = [f"n{rng.randint(0, 11)}" for _ in range(rng.randint(1, 3))]
            dst = f"n{rng.randint(0, 11) if cycles else 12 + k}"
            if not cycles and k:
                sources = [f"n{rng.randint(0, 11 + k)}" for _ in sources]
            edges.append((k, sources, dst))
        made = [(k, v, dst, "dsir", "model", "AND", s, "dsir", "model", v, 1.0) for k, sources, dst in edges for v, s in enumerate(sources)]
        index = Timelines(spark.createDataFrame(made, mini.SCHEMA))
        nodes = {x for _, sources, dst in edges for x in (*sources, dst)}
        found = {}
        for r in index.models.collect():
            found.setdefault((r["start"], r["direction"]), set()).add(r["node_id"])
        sizes = {(r["start"], r["direction"]): r["n_nodes"] for r in index.sizes().collect()}
        for x in nodes:
            behind, ahead = {x}, {x}
            for _ in nodes:
                behind |= {s for _, sources, dst in edges if dst in behind for s in sources}
                ahead |= {y for _, sources, dst in edges if ahead & set(sources) for y in (*sources, dst)}
            assert found.get((x, "backward"), set()) == behind - {x} and found[x, "forward"] == ahead
            assert (sizes[x, "backward"], sizes[x, "forward"]) == (len(behind) - 1, len(ahead))
        x = sorted(nodes)[3]
        assert sorted(r["node_id"] for r in index.model_timeline(x).collect()) == sorted([*found.get((x, "backward"), ()), *found[x, "forward"]])
        assert rows(index.timeline("absent"), "node_id", "direction") == [("absent", "forward")] and rows(index.model_timeline("absent"), "node_id") == [("absent",)]
        assert {r["node_id"] for r in index.backward(x).collect()} == found.get((x, "backward"), set()) | {x}


def test_engine(spark):
    jobs = [{"_id": "r1", "input_dsars": ["s0"], "output_dsir": "j", "model_type": "m", "relevance": 0.5}]
    t = tables(spark, [record("j", JG, children=["p"]), record("p", PSM, ["j"], dsar="g")], [group("s0", AM, [], "undefined"), group("g", PSM, ["p"])], jobs)
    engine = Engine(t)
    assert engine.model_graph() is None and engine.optimal_path() is None
    assert [r["name"] for r in engine.model_graph(generate=True).collect()] == ["m"]
    assert rows(engine.optimal_path(generate=True), "dsir_id") == [("p",)]
    assert rows(engine.timeline("g"), "node_id") == [("g",)]
    assert '"dsir_id":"p"' in engine.response(engine.optimal_path()).first()["json"]
    assert {r["colour"] for r in engine.drawing(optimal=True).collect()} == {"r"}


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert rows(store.upsert(df, ["k"], "seq"), "k", "v") == [("a", "y"), ("b", "z")]
    assert {r["k"]: r["vs"] for r in store.push(df, ["k"], "v", "seq", "vs").collect()} == {"a": ["x", "y"], "b": ["z"]}
    assert store.insert(df, df).count() == 6 and store.truncate(df).count() == 0
    assert rows(store.find(df, {"k": "a"}, ["v"]), "v") == [("x",), ("y",)]
    t = tables(spark, [record("a", JG, ["b"]), record("b", PSM, dsar="g")], [group("g", PSM, ["b"])])
    documents.write_tables(t, str(tmp_path))
    again = documents.read_tables(spark, str(tmp_path))
    assert rows(again["dsir_parent"], "dsir_id", "parent_id") == [("a", "b")]
    (tmp_path / "docs").mkdir()
    for name, data in (("dsir", [record("a", JG)]), ("dsar", [group("g", PSM, [])]), ("jobs", [])):
        import json

        (tmp_path / "docs" / name).write_text("\n".join(json.dumps(x) for x in data))
    dsir, dsar, jobs = documents.read_documents(spark, str(tmp_path / "docs"))
    assert (dsir.count(), dsar.count(), jobs.count()) == (1, 1, 0)


def test_empty_store(spark):
    t = tables(spark)
    assert model_graph.graph(t).count() == 0 and FlowGraph(t).rows.count() == 0 and documents.validate(t).count() == 0


def test_path_counts_of_any_length(spark):
    """Each of 14 steps back has a thousand ways: counts of up to 43 digits."""
    steps = [(f"n{k}", "model", f"n{k + 1}", "model", pos) for k in range(14) for pos in range(1000)]
    graph = spark.createDataFrame(steps, "dst string, dst_type string, src string, src_type string, pos int")
    found = {r["node_id"]: r["n_paths"] for r in traverse.written_counts(traverse.path_counts(graph, "n0", "model")).collect()}
    assert found == {f"n{k}": str(1000**k) for k in range(15)}


def test_connectors_of_a_frequent_parent(spark):
    """A parent that most nodes share is dealt over tasks, and no pair is lost or made twice."""
    left = spark.createDataFrame([(f"r{k}", "a" if k % 10 else "b", k) for k in range(300)], "dsir_id string, via string, pos1 int")
    right = spark.createDataFrame([(v, k) for v in "abc" for k in range(150)], "via string, last int")
    want = Counter((r["dsir_id"], r["via"], k) for r in left.collect() for k in range(150))
    assert Counter(tuple(r) for r in model_graph.spread(left, right, "via", share=20).select("dsir_id", "via", "last").collect()) == want


def test_arrays_of_a_list_are_neither_many_nor_long(spark):
    """A list of 150 travels as one array, one of 2,500 as three."""
    left = spark.createDataFrame([(f"r{k}", v) for v in "ab" for k in range(3)], "dsir_id string, via string")
    right = spark.createDataFrame([("a", k) for k in range(150)] + [("b", k) for k in range(2500)], "via string, last int").repartition(5)
    want = Counter((r["dsir_id"], r["via"], k) for r in left.collect() for k in range(150 if r["via"] == "a" else 2500))
    for part in (None, F.floor(F.col("last") / model_graph.PART)):
        assert Counter(r["via"] for r in model_graph.arrays(right, "via", part).collect()) == {"a": 1, "b": 3}
        assert Counter(tuple(r[c] for c in ("dsir_id", "via", "last")) for r in model_graph.spread(left, right, "via", part).collect()) == want


def test_lists_of_many_and_few_stubs(spark):
    """A result with more stubs than are grouped by class, and runs that share theirs."""
    runs = [record(f"j{k:03}", JG, ["p", "q"]) for k in range(50)]
    t = tables(spark, [*runs, record("p", AM, ["g", "h"]), record("q", AM, ["h"]), record("g", JG), record("h", JG), record("r", PSM, [f"j{k:03}" for k in range(50)])])
    graph = {r["periods"][0]["id"]: [c["connectTo"] for c in r["periods"][0]["connector"]] for r in model_graph.graph(t).collect()}
    assert graph["r"] == ["g", "h", "h"] * 50 and all(graph[f"j{k:03}"] == ["g", "h", "h"] for k in range(50)) and graph["g"] == []
    same = store.to_json(model_graph.graph(t)).exceptAll(model_graph.graph_json(t))
    assert same.count() == 0 and model_graph.graph_json(t).count() == 53
    assert rows(model_graph.edge_counts(t).where("dsir_id in ('r', 'j007')"), "dsir_id", "connect_to", "n") == [("j007", "g", 1), ("j007", "h", 2), ("r", "g", 50), ("r", "h", 100)]


def test_lists_are_made_last(spark, sf):
    """Nothing is joined, so nothing is exchanged or sorted, once the lists stand."""
    from tracewright.sources.orders import tables as derived

    t = derived(spark, sf)
    for made in (model_graph.graph_json(t), model_graph.graph_digests(t), model_graph.graph(t)):
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]


def test_nodes_without_connectors_keep_an_empty_list(spark):
    t = tables(spark, [record("alone", JG), record("j", JG, ["p"]), record("p", AM, []), record("k", JG, ["gone"])])
    assert sorted(r["json"] for r in model_graph.graph_json(t).collect()) == ['{"name":"m","periods":[{"id":"%s","start":0,"end":1,"connector":[]}]}' % x for x in ("alone", "j", "k")]
    assert rows(model_graph.graph_digests(t), "id", "n_connectors") == [("alone", 0), ("j", 0), ("k", 0)]


def test_numbered_tables_are_written_once(spark, monkeypatch, sf):
    """A flow graph writes its incidences, its edges and its numbered rows: three tables, not five."""
    from tracewright.functions import ranks
    from tracewright.operators import flow_graph
    from tracewright.sources.orders import tables as derived

    written, t = [], derived(spark, sf)
    for module in (flow_graph, ranks):
        monkeypatch.setattr(module, "stored", lambda df, kept=module.stored: written.append(df.columns) or kept(df))
    flow = FlowGraph(t)
    assert len(written) == 3
    for df, name in ((flow.edges, "edge_ord"), (flow.rows, "var_ord")):
        n = df.count()
        assert sorted(r[0] for r in df.select(name).collect()) == list(range(n))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_are_gapless_over_any_partitions(spark, n):
    from tracewright.functions.ranks import ordinals

    df = spark.createDataFrame([((k * 7919) % 503,) for k in range(n)], "x int")
    assert sorted(map(tuple, ordinals(df, ["x"], "o").collect())) == [(x, o) for o, x in enumerate(sorted((k * 7919) % 503 for k in range(n)))]
