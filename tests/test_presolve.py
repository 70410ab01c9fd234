"""Programs that are no network: made small as tables, solved, and held against plain search."""

import itertools
import random

from pyspark.sql import functions as F

from tracewright.functions.lineage import Scratch
from tracewright.operators import presolve, program, solver
from tracewright.plans import registry


def every_best(weights, rows):
    """The greatest total of a choice within all ranges, by trying each."""
    best = None
    for x in itertools.product((0, 1), repeat=len(weights)):
        if all(lo <= sum(c * x[v] for v, c in coefs.items()) <= hi for coefs, lo, hi in rows):
            total = sum(w * k for w, k in zip(weights, x, strict=True))
            best = total if best is None else max(best, total)
    return best


def test_frontier_against_all_choices():
    chance, none = random.Random(5), 0
    for _ in range(300):
        n = chance.randint(1, 9)
        weights = [chance.randint(-9, 9) for _ in range(n)]
        rows = []
        for _ in range(chance.randint(0, 6)):
            coefs = {v: chance.choice((-3, -2, -1, 1, 1, 2, 3)) for v in chance.sample(range(n), chance.randint(1, n))}
            lo = chance.randint(-2, 1)
            rows.append((coefs, lo, lo + chance.randint(0, 2)))
        found, best = presolve.frontier(weights, rows), every_best(weights, rows)
        none += best is None
        assert (found and found[0]) == best
        if found:
            assert found[0] == sum(weights[v] for v in found[1])
            assert all(lo <= sum(c for v, c in coefs.items() if v in found[1]) <= hi for coefs, lo, hi in rows)
    assert 0 < none < 200
    assert presolve.frontier([], []) == (0, []) and presolve.frontier([], [({}, 1, 1)]) is None


def test_frontier_gives_up_beyond_its_states():
    rows = [({v: 1, v + 20: -1}, 0, 0) for v in range(20)] + [({v: v % 5 + 1 for v in range(40)}, 30, 30)]
    try:
        presolve.frontier([1] * 40, rows, most_states=3)
    except ValueError as e:
        assert "3 sums" in str(e)
    else:
        raise AssertionError("not refused")


def component(chance):
    """A small program of the kinds of equations that presolve looks for: g * (...) = all sources, one
    of many equals, slacks, x = y, and any others. (weights, equations)"""
    weights, rows = [], []

    def new(k=1):
        weights.extend(chance.choice((0.0, 0.1, 0.2, 0.3, 0.7, 0.25)) for _ in range(k))
        return list(range(len(weights) - k, len(weights)))

    top = new()[0]
    for _ in range(chance.randint(1, 2)):
        parts, ways = new(2), new(chance.randint(1, 4))
        rows.append({**dict.fromkeys(parts, 1), **dict.fromkeys(ways, -2)})
        rows.append({top: 1, new()[0]: 1, parts[0]: -1} if chance.random() < 0.6 else {top: 1, parts[0]: -1})
        for w in ways[: chance.randint(0, 4)]:
            rows.append({w: 1, **dict.fromkeys(new(chance.randint(0, 2)), 1), top: -1})
    if chance.random() < 0.5:
        held = chance.sample(range(len(weights)), min(4, len(weights)))
        rows.append({v: chance.choice((-2, -1, 1, 2, 3)) for v in held})
    return weights, rows


def test_programs_made_small_against_search(spark, monkeypatch):
    monkeypatch.setattr(solver, "SEARCHED", 0)
    chance, parts = random.Random(11), []
    while len(parts) < 80:
        weights, rows = component(chance)
        if len(weights) <= 16:
            sink = {v: 1 for v in chance.sample(range(len(weights)), 2)} if chance.random() < 0.4 else {}
            parts.append((weights, rows, sink))
    wide, terms, ends, off, best, starts = [], [], [], 0, [], []
    for k, (weights, rows, sink) in enumerate(parts):
        starts.append(off)
        wide += [(off + v, w) for v, w in enumerate(weights)]
        terms += [(f"r{k}-{r}", "n", off + v, c) for r, coefs in enumerate(rows) for v, c in coefs.items()]
        ends += [(off + v, c) for v, c in sink.items()]
        off += len(weights)
        scaled = [round(w * 100) for w in weights]
        by_units = []
        for units in (0, 1) if sink else (0,):
            found = solver._search(scaled, [*((r, 0) for r in rows), *([(sink, units)] if sink else [])])
            by_units.append(found and found[0])
        best.append(by_units)
    w = spark.createDataFrame(wide, "var_ord long, weight double")
    e = spark.createDataFrame(terms, "node_id string, node_type string, var_ord long, coef long")
    s = spark.createDataFrame(ends, "var_ord long, coef long")
    found = solver.solve_program(w, e, s)
    chosen = {r["var_ord"] for r in found.chosen.collect()}
    assert len(chosen) == found.chosen.count()
    units = 0
    for k, (weights, rows, sink) in enumerate(parts):
        own = {v for v in range(len(weights)) if starts[k] + v in chosen}
        assert all(sum(c for v, c in coefs.items() if v in own) == 0 for coefs in rows)
        into = sum(c for v, c in sink.items() if v in own)
        units += into
        assert round(sum(weights[v] for v in own) * 100) == best[k][into]
    gains = [b[1] - b[0] for b in best if len(b) == 2 and b[1] is not None]
    assert units == 1 and round(found.total * 100) == sum(b[0] for b in best) + max(gains)


def test_first_program_is_made_small_whatever_its_size(spark, sf):
    """What a task gets of the program with position "first" goes by models and clusters, not by records."""
    rows = registry.flow(spark, sf).rows
    equations = program.constraints(rows, "first").select(F.concat_ws("|", "node_type", "node_id").alias("row"), "var_ord", "coef")
    ends = program.sink(rows)
    weights = program.objective(rows).join(equations.select("var_ord").union(ends.select("var_ord")).distinct(), "var_ord").select("var_ord", (F.col("weight") * 2.0**40).cast("long").cast("decimal(38,0)").alias("w"))
    with Scratch(spark) as keep:
        left = presolve.reduced(keep(weights), keep(equations), keep(ends), keep)
        assert weights.count() > 3000 and left.weights.count() <= 300 and left.rounds < 6
        assert {kind for kind, _ in left.steps} == {"same", "slack"}
        assert left.expanded(left.weights.select("var_ord").limit(0), keep).isEmpty()
