"""Exact solution of the selection program.

Variables in no equation are chosen where they gain. The others are arcs of a network where their
equations are the balance of one, which those of flow graphs with equal fan-in and fan-out are. The
network is contracted as a table (``contract``) until at most ``enough`` arcs are left, or no more go;
a task then gets what is left, by component if it is more. Components with an equation that is no
balance are solved as a whole: small ones by depth-first branch and bound with propagation of the
equations, larger ones are made small as tables (``presolve``), and a task then takes what is left,
component by component, keeping the best choice for each state of the rows begun. What is left is
refused beyond ``max_vars`` variables, rather than answered without proof. Nothing at all is
feasible, so a component is solved for 0 and for 1 unit into the sink, and the one unit goes where it
gains most. Among equal totals the lexicographically smallest list of chosen variables wins, but for
larger components that are no network: they take one of the best, the same in every run.

Weights are doubles, taken as whole numbers times a power of two, so totals are exact for any
weights. A network's solution comes with node prices that prove it (``certificate``).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import Scratch, cut
from . import network, program
from .components import components
from .contract import END, IN, OUT, Arcs, built, contracted, merged
from .network import heaviest, whole
from .presolve import Reduced, frontier, reduced

#: Components of more variables than this that are no network are made small first.
SEARCHED = 64


def _search(weights: list, rows: list[tuple[dict[int, int], int]], nodes_left: int = 5_000_000) -> tuple[float, list[int]] | None:
    """The best 0/1 choice under equations (coefficients by variable, right side), or None."""
    n = len(weights)
    of: list[list[int]] = [[] for _ in range(n)]
    for r, (coefs, _) in enumerate(rows):
        for v in coefs:
            of[v].append(r)
    value = [-1] * n
    need = [rhs for _, rhs in rows]
    low = [sum(min(0, c) for c in coefs.values()) for coefs, _ in rows]
    high = [sum(max(0, c) for c in coefs.values()) for coefs, _ in rows]
    best: list = [None, None]
    budget = [nodes_left]

    def put(v: int, x: int, trail: list[int]) -> bool:
        todo = [(v, x)]
        while todo:
            v, x = todo.pop()
            if value[v] >= 0:
                if value[v] != x:
                    return False
                continue
            value[v] = x
            trail.append(v)
            for r in of[v]:
                c = rows[r][0][v]
                low[r] -= min(0, c)
                high[r] -= max(0, c)
                need[r] -= c * x
            for r in of[v]:
                if not low[r] <= need[r] <= high[r]:
                    return False
                for u, c in rows[r][0].items():
                    if value[u] < 0:
                        zero = low[r] - min(0, c) <= need[r] <= high[r] - max(0, c)
                        one = low[r] - min(0, c) <= need[r] - c <= high[r] - max(0, c)
                        if not zero and not one:
                            return False
                        if zero != one:
                            todo.append((u, int(one)))
        return True

    def undo(trail: list[int]) -> None:
        for v in reversed(trail):
            for r in of[v]:
                c = rows[r][0][v]
                low[r] += min(0, c)
                high[r] += max(0, c)
                need[r] += c * value[v]
            value[v] = -1

    def go(v: int) -> None:
        budget[0] -= 1
        if budget[0] < 0:
            raise RuntimeError("the search is too large to prove an optimum")
        while v < n and value[v] >= 0:
            v += 1
        bound = sum(w for w, x in zip(weights, value, strict=True) if x == 1 or (x < 0 and w > 0))
        if best[0] is not None and bound < best[0]:
            return
        if v == n:
            chosen = [k for k, x in enumerate(value) if x == 1]
            if best[0] is None or bound > best[0] or (bound == best[0] and chosen < best[1]):
                best[0], best[1] = bound, chosen
            return
        for x in (1, 0):
            trail: list[int] = []
            if put(v, x, trail):
                go(v + 1)
            undo(trail)

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * n + 1000))
    trail: list[int] = []
    start = True
    for coefs, rhs in rows:
        if not coefs and rhs:
            start = False
    if start and all(lo <= ne <= hi for lo, ne, hi in zip(low, need, high, strict=True)):
        go(0)
    undo(trail)
    return None if best[0] is None else (best[0], best[1])


def solve_component(frame: pd.DataFrame, max_vars: int, shift: int) -> pd.DataFrame:
    """frame: (root, kind, row, var_ord, coef, weight), kind 'w' for a variable's weight, 'c' for an
    equation's coefficient, 's' for the sink's. Returns (root, units, total, chosen); totals are
    whole numbers times 2**-shift."""
    weights = frame[frame.kind == "w"].sort_values("var_ord")
    order = weights.var_ord.tolist()
    at = {v: k for k, v in enumerate(order)}
    equations: dict[str, dict[int, int]] = {}
    held = frame[frame.kind == "c"]
    for row, v, c in zip(held["row"].tolist(), held.var_ord.tolist(), held.coef.tolist(), strict=True):
        equations.setdefault(row, {})[at[v]] = int(c)
    rows = [(coefs, 0) for coefs in equations.values()]
    ends = frame[frame.kind == "s"]
    sink = {at[v]: int(c) for v, c in zip(ends.var_ord, ends.coef, strict=True)}
    out, values = [], weights.weight.tolist()
    exact, own = whole(values)
    for units in (0, 1) if sink else (0,):
        found = heaviest(values, [coefs for coefs, _ in rows], sink, units) if min(values) >= 0 else None
        if found is None:
            if len(order) > max_vars:
                raise ValueError(f"a component of {len(order)} variables is no network and over the limit of {max_vars}")
            found = _search(exact, [*rows, (sink, units)] if sink else rows)
        if found:
            total = sum(exact[k] for k in found[1]) << (shift - own)
            out.append((frame.root.iloc[0], units, str(total), [order[k] for k in found[1]]))
    return pd.DataFrame(out, columns=["root", "units", "total", "chosen"], dtype=object)


def _arrays(frame: pd.DataFrame) -> tuple:
    """(tail, head, weights, names of the nodes) of a group's arcs, source, drain and sink first."""
    names = [OUT, IN, END]
    at = {x: k for k, x in enumerate(names)}
    for x in (*frame["tail"].tolist(), *frame["head"].tolist()):
        if x not in at:
            at[x] = len(names)
            names.append(x)
    tail, head = (np.array([at[x] for x in frame[c].tolist()], np.int64) for c in ("tail", "head"))
    return tail, head, network.numbers([int(w) for w in frame["w"].tolist()]), names


def solve_arcs(frame: pd.DataFrame) -> pd.DataFrame:
    """frame: (root, arc, tail, head, w) to (root, units, total, chosen arcs)."""
    tail, head, weight, names = _arrays(frame)
    out, arc = [], frame["arc"].to_numpy()
    for units in (0, 1) if (head == network.SINK).any() else (0,):
        used = network.flow(tail, head, weight, len(names), units)
        if used is not None:
            out.append((frame["root"].iloc[0], units, str(sum(weight[used].tolist())), sorted(arc[used].tolist())))
    return pd.DataFrame(out, columns=["root", "units", "total", "chosen"], dtype=object)


def price_nodes(frame: pd.DataFrame, end: int) -> pd.DataFrame:
    """frame: (arc, tail, head, w, x) to (node, price): the potentials of a heaviest flow if a unit
    in the sink is paid for with ``end``."""
    tail, head, weight, names = _arrays(frame)
    last = head == network.SINK
    weight = network.numbers([w - end if k else w for w, k in zip(weight.tolist(), last.tolist(), strict=True)])
    price = network.potentials(tail, np.where(last, network.DRAIN, head), weight, len(names), frame["x"].to_numpy())
    return pd.DataFrame({"node": names[3:], "price": [Decimal(int(p)) for p in price[3:].tolist()]}, dtype=object)


def smallest_arcs(frame: pd.DataFrame) -> pd.DataFrame:
    """frame: (arc, tail, head, x), all tied, to the arcs whose x changes."""
    frame = frame.sort_values("arc").assign(w=0)
    tail, head, _, names = _arrays(frame)
    used = frame["x"].to_numpy()
    new = network.smallest(tail, head, frame["arc"].tolist(), len(names), used, np.arange(len(frame)))
    return pd.DataFrame({"arc": frame["arc"].to_numpy()[new != used]})


def turn_arcs(frame: pd.DataFrame, end: int) -> pd.DataFrame:
    """frame: (root, arc, tail, head, w, x) to one row (root, loss, arcs): the arcs to turn over for
    the next best choice of the group, if a unit in the sink is paid for with ``end``."""
    tail, head, weight, names = _arrays(frame)
    used, n = frame["x"].to_numpy(), len(names)
    paid = network.numbers([w - end if k else w for w, k in zip(weight.tolist(), (head == network.SINK).tolist(), strict=True)])
    price = network.potentials(tail, np.where(head == network.SINK, network.DRAIN, head), paid, n, used)
    price[network.SINK] = end
    found = network.cheapest_turn(tail, head, weight, n, used, price)
    out = [] if found is None else [(frame["root"].iloc[0], str(found[0]), frame["arc"].to_numpy()[found[1]].tolist())]
    return pd.DataFrame(out, columns=["root", "loss", "arcs"], dtype=object)


def next_choice(weights: list[int], rows: list[tuple[dict[int, int], int]], best: list[int]) -> tuple[int, list[int]] | None:
    """The best choice but for ``best``, by parting all others at the first variable in which they
    differ from it (Murty 1968, Lawler 1972) and searching each part."""
    taken, found = set(best), None
    for k in range(len(weights)):
        fixed = [({v: 1}, int(v in taken)) for v in range(k)] + [({k: 1}, int(k not in taken))]
        part = _search(weights, [*rows, *fixed])
        if part is not None and (found is None or part[0] > found[0] or (part[0] == found[0] and part[1] < found[1])):
            found = part
    return found


@dataclass
class Solution:
    """chosen(var_ord); total; shift: weights and prices are whole numbers times 2**-shift. For the
    part that is a network: arcs(arc, tail, head, w, x), kind(var_ord, arc) and prices(node, price),
    and how many arcs tasks were given at most. second(var_ord) and second_exact: the next best
    choice, where it was asked for and there is one."""

    chosen: DataFrame
    total: float
    exact: int
    shift: int
    arcs: DataFrame | None = None
    kind: DataFrame | None = None
    prices: DataFrame | None = None
    most_arcs: int = 0
    second: DataFrame | None = None
    second_exact: int | None = None


def solve(rows: DataFrame, position: str = "exact", max_vars: int = 4000) -> DataFrame:
    """(var_ord, total): the chosen variables and the optimum. Raises if there is no sink or no
    feasible choice."""
    found = solution(rows, position, max_vars)
    return found.chosen.withColumn("total", F.lit(found.total))


def solution(rows: DataFrame, position: str = "exact", max_vars: int = 4000, enough: int = 20_000, second: bool = False) -> Solution:
    ends = program.sink(rows)
    if ends.isEmpty():
        raise ValueError("no sink: every model leads to another one")
    return solve_program(program.objective(rows), program.constraints(rows, position), ends, max_vars, enough, second)


def _low_bits():
    """A vectorised function: the place of a double's lowest bit, null for 0."""
    import pyarrow as pa

    def of(w: pa.Array) -> pa.Array:
        part, power = np.frexp(w.to_numpy(zero_copy_only=False))
        bits = np.abs(part * 2.0**53).astype(np.int64)
        low = np.frexp((bits & -bits).astype(np.float64))[1] - 1
        return pa.array(power - 53 + low, pa.int64(), mask=bits == 0)

    of.__annotations__ = {"w": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "long")


def _scaled(shift: int):
    """A vectorised function: doubles times 2**shift as decimals."""
    import pyarrow as pa

    def of(w: pa.Array) -> pa.Array:
        out = [(n << shift) // d for n, d in (x.as_integer_ratio() for x in w.to_pylist())]
        return pa.array([Decimal(n) for n in out], pa.decimal128(38, 0))

    of.__annotations__ = {"w": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "decimal(38,0)")


def solve_program(weights: DataFrame, equations: DataFrame, ends: DataFrame, max_vars: int = 4000, enough: int = 20_000, second: bool = False) -> Solution:
    """weights(var_ord, weight), equations(node_id, node_type, var_ord, coef), ends(var_ord, coef).
    A variable in no equation is chosen if it gains; only the others form components. With ``second``
    the next best choice is found too: of a network by the cycle of arcs that loses least, of another
    program (in one component) by parting the choices at the first variable that differs."""
    with Scratch(weights.sparkSession) as keep:
        return _solved(weights, equations, ends, max_vars, enough, keep, second)


def _solved(weights: DataFrame, equations: DataFrame, ends: DataFrame, max_vars: int, enough: int, keep: Scratch, second: bool) -> Solution:
    spark = weights.sparkSession
    named = keep(equations.select(F.concat_ws("|", "node_type", "node_id").alias("row"), "var_ord", F.col("coef").cast("long").alias("coef")))
    weights, ends = keep(weights.select("var_ord", F.col("weight").cast("double").alias("weight"))), keep(ends.select("var_ord", "coef"))
    facts = weights.agg(F.min(_low_bits()("weight")).alias("low"), F.max(F.abs("weight")).alias("most"), F.min("weight").alias("least"), F.count("*").alias("n"), F.count(F.when(F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf")), 1)).alias("wrong")).first()
    if facts["wrong"]:
        raise ValueError(f"{facts['wrong']} weights are null or no number")
    shift = max(0, -(facts["low"] or 0))
    over, under = float(facts["most"] or 0).as_integer_ratio()
    room = 8 * (facts["n"] + 1) * ((over << shift) // under + 1)  # sums and prices stay below
    bound = keep(named.select("var_ord").unionByName(ends.select("var_ord")).distinct())
    alone = keep(weights.join(bound, "var_ord", "left_anti").where("weight > 0"))
    held = keep(weights.join(bound, "var_ord", "left_semi"))

    short = room < 1 << 62
    parts = 2.0 ** min(shift, 1000), 2.0 ** max(0, shift - 1000)
    w = (F.col("weight") * parts[0] * parts[1]).cast("long") if short else _scaled(shift)("weight")
    made = net = None
    search = held
    if facts["least"] is not None and facts["least"] >= 0 and room < 10**38:
        made = built(held.select("var_ord", w.alias("w")), named, ends, keep)
        search = _odd_components(held, named, made, keep)
        net = made.arcs if search is None else keep(made.arcs.join(search.select(F.col("var_ord").alias("arc")), "arc", "left_anti"))
    candidates, small, most = [], None, 0
    if net is not None:
        small = contracted(net, enough, keep)
        grouped = keep(_rooted(small.arcs, small.n, enough, keep))
        most = grouped.groupBy("root").count().agg(F.max("count")).first()[0] or 0
        candidates.append(grouped.groupBy("root").applyInPandas(solve_arcs, "root long, units int, total string, chosen array<long>").withColumn("by", F.lit("arcs")))
    core = None
    if search is not None:
        search = keep(_with_roots(search, named))
        large = keep(search.groupBy("root").count().where(F.col("count") > SEARCHED).select("root"))
        if room * 8 * _most_coef(named) < 10**38 and not large.isEmpty():  # sums of moved weights stay below
            within = keep(search.join(large, "root", "left_semi").select("var_ord", _scaled(shift)("weight").alias("w")))
            inside = lambda df: keep(df.join(within.select("var_ord"), "var_ord", "left_semi"))
            core = reduced(within, inside(named.select("row", "var_ord", "coef")), inside(ends.select("var_ord", F.col("coef").cast("long").alias("coef"))), keep)
            candidates.append(_core_components(core, max_vars, keep).withColumn("by", F.lit("core")))
            search = keep(search.join(large, "root", "left_anti"))
        candidates.append(_by_component(search, named, ends, max_vars, shift).withColumn("by", F.lit("search")))
    solved = keep(reduce(DataFrame.unionByName, candidates).withColumn("total", F.col("total").cast("decimal(38,0)") if room < 10**38 else F.col("total")))
    none, one = solved.where("units = 0"), solved.where("units = 1").select("by", "root", F.col("total").alias("with_one"), F.col("chosen").alias("chosen_one"))
    key = ["by", "root"]
    pairs = one.join(none.select(*key, "total"), key, "left")
    if room < 10**38:
        winner = pairs.withColumn("gain", F.col("with_one") - F.coalesce("total", F.lit(0))).orderBy(F.desc("gain"), "chosen_one").select(*key, F.col("gain").cast("string").alias("gain")).limit(1).collect()
    else:  # weights that no decimal holds: the gains of the components with a sink, one number each
        winner = sorted(pairs.select(*key, F.element_at("chosen_one", 1).alias("c"), (F.col("with_one")).alias("x"), F.coalesce("total", F.lit("0")).alias("y")).collect(), key=lambda r: (int(r["y"]) - int(r["x"]), r["c"]))[:1]
    if not winner:
        raise ValueError("no feasible choice brings one unit into the sinks")
    top = winner[0]
    here = (F.col("by") == top["by"]) & (F.col("root") == top["root"])
    picked = keep(none.where(~here).select("by", "chosen").unionByName(one.where(here).select("by", F.col("chosen_one").alias("chosen"))).select("by", F.explode("chosen").alias("arc")))
    chosen = picked.where("by = 'search'").select(F.col("arc").alias("var_ord")).unionByName(alone.select("var_ord"))
    if core is not None:
        chosen = chosen.unionByName(core.expanded(keep(picked.where("by = 'core'").select(F.col("arc").alias("var_ord"))), keep))
    out = Solution(chosen, 0.0, 0, shift)
    if net is not None:
        end = int(top["gain"])
        final = small.arcs.join(picked.where("by = 'arcs'").select("arc", F.lit(True).alias("x")), "arc", "left").withColumn("x", F.coalesce("x", F.lit(False)))
        final = keep(_rooted(final, small.n, enough, keep))
        prices = final.groupBy("root").applyInPandas(lambda f: price_nodes(f, end), "node string, price decimal(38,0)")
        special = spark.createDataFrame([(OUT, Decimal(0)), (IN, Decimal(0)), (END, Decimal(end))], "node string, price decimal(38,0)")
        prices_ = small.priced(keep(prices.unionByName(special)), keep)
        taken = small.expanded(final.where("x").select("arc"), keep)
        full = net.join(taken.withColumn("x", F.lit(True)), "arc", "left").withColumn("x", F.coalesce("x", F.lit(False)))
        out.arcs, tied = _told_apart(keep(full), prices_, enough, keep)
        out.prices = cut(prices_) if search is None else None
        out.kind, out.most_arcs = cut(made.kind), max(most, tied)
        arcs = out.arcs.where("x").select("arc")
        out.chosen = chosen.unionByName(arcs.select(F.col("arc").alias("var_ord"))).unionByName(made.kind.where("var_ord <> arc").join(arcs, "arc").select("var_ord"))
        out.chosen = _trimmed(keep(out.chosen), weights, named, ends, keep)
        if out.arcs is not None:  # arcs that trimming dropped
            out.arcs = cut(out.arcs.drop("x").join(out.chosen.select(F.col("var_ord").alias("arc"), F.lit(True).alias("x")), "arc", "left").withColumn("x", F.coalesce("x", F.lit(False))))
    out.chosen = cut(out.chosen)
    exact = out.chosen.join(weights, "var_ord").groupBy("weight").agg(F.count("*").alias("n"))
    if room < 10**38:
        out.exact = int(exact.agg(F.sum(_scaled(shift)("weight") * F.col("n"))).first()[0] or 0)
    else:
        out.exact = sum(int(r["total"]) for r in solved.where((F.col("units") == 0) & ~here | (F.col("units") == 1) & here).select("total").collect())
        out.exact += sum((n << shift) // d * r["n"] for r in alone.groupBy("weight").agg(F.count("*").alias("n")).collect() for n, d in [r["weight"].as_integer_ratio()])
    out.total = out.exact / (1 << shift)
    if second and search is None:
        free = weights.join(bound, "var_ord", "left_anti")
        _add_second(out, final, small, made, int(top["gain"]), alone, free, weights, keep)
    elif second:
        _search_second(out, weights, named, ends, max_vars)
    return out


def _add_second(out: Solution, final: DataFrame, small, made: Arcs, end: int, alone: DataFrame, free: DataFrame, weights: DataFrame, keep: Scratch) -> None:
    """The next best choice of a network: a variable in no equation turned over, or a cycle."""

    def variables(arcs: DataFrame) -> DataFrame:
        arcs = small.expanded(arcs, keep)
        both = arcs.select(F.col("arc").alias("var_ord")).unionByName(made.kind.where("var_ord <> arc").join(arcs, "arc").select("var_ord"))
        return keep(both.unionByName(alone.select("var_ord")))

    first = variables(final.where("x").select("arc"))
    if not first.exceptAll(out.chosen).unionByName(out.chosen.exceptAll(first)).isEmpty():
        out.second, out.second_exact = cut(first), out.exact  # of two equal totals the other one
        return
    turns = final.groupBy("root").applyInPandas(lambda f: turn_arcs(f, end), "root long, loss string, arcs array<long>")
    turns = keep(turns.withColumn("loss", F.col("loss").cast("decimal(38,0)")))
    least = turns.orderBy("loss", "root").limit(1).collect()
    single = free.select("var_ord", F.abs("weight").alias("loss")).orderBy("loss", "var_ord").limit(1).collect()
    loss = [whole([r["loss"]]) for r in single]
    loss = [x[0] << (out.shift - k) for x, k in loss]
    if single and (not least or loss[0] <= int(least[0]["loss"])):
        k = single[0]["var_ord"]
        kept = out.chosen.where(F.col("var_ord") != k)
        if kept.count() == out.chosen.count():
            kept = kept.unionByName(out.chosen.sparkSession.createDataFrame([(k,)], out.chosen.schema))
        out.second, out.second_exact = cut(kept), out.exact - loss[0]
    elif least:
        turned = turns.where(F.col("root") == least[0]["root"]).select(F.explode("arcs").alias("arc"), F.lit(True).alias("t"))
        x = final.join(turned, "arc", "left").where(F.col("x") != F.coalesce("t", F.lit(False))).select("arc")
        out.second, out.second_exact = cut(variables(x)), out.exact - int(least[0]["loss"])


def _search_second(out: Solution, weights: DataFrame, named: DataFrame, ends: DataFrame, max_vars: int) -> None:
    n = weights.count()
    if n > max_vars:
        raise ValueError(f"a program of {n} variables is no network and over the limit of {max_vars}")
    order = sorted(r["var_ord"] for r in weights.select("var_ord").collect())  # max_vars at most
    at = {v: k for k, v in enumerate(order)}
    exact = [0] * n
    for r in weights.collect():
        over, under = r["weight"].as_integer_ratio()
        exact[at[r["var_ord"]]] = (over << out.shift) // under
    rows: dict[str, dict[int, int]] = {}
    for r in named.collect():
        rows.setdefault(r["row"], {})[at[r["var_ord"]]] = r["coef"]
    sink = {at[r["var_ord"]]: r["coef"] for r in ends.collect()}
    best = [at[r["var_ord"]] for r in out.chosen.collect()]
    found = next_choice(exact, [*((c, 0) for c in rows.values()), (sink, 1)], best)
    if found:
        out.second_exact = found[0]
        out.second = cut(weights.sparkSession.createDataFrame([(order[k],) for k in found[1]], "var_ord long"))


def _rooted(arcs: DataFrame, n: int, enough: int, keep: Scratch) -> DataFrame:
    """arcs with the group that a task gets: all together while they are few, else by component."""
    if n <= enough:
        return arcs.withColumn("root", F.lit(0).cast("long"))
    hub = lambda side: arcs.where(~F.col(side).isin(OUT, IN, END)).select(F.col(side).alias("node"), "arc")
    ends = keep(hub("tail").unionByName(hub("head")))
    first = ends.groupBy("node").agg(F.min("arc").alias("b"))
    links = ends.join(first, "node").select(F.col("arc").alias("a"), "b")
    return arcs.join(components(arcs.select(F.col("arc").alias("node")), links).toDF("arc", "root"), "arc")


def _linked(named: DataFrame) -> DataFrame:
    hub = named.groupBy("row").agg(F.min("var_ord").alias("b"))
    return named.join(hub, "row").select(F.col("var_ord").alias("a"), "b")


def _odd_components(held: DataFrame, named: DataFrame, made: Arcs, keep: Scratch) -> DataFrame | None:
    """The variables of components that hold an equation which is no balance, with their root; None
    if there is none."""
    odd = keep(made.odd.distinct())
    if odd.isEmpty():
        return None
    roots = keep(components(held.select(F.col("var_ord").alias("node")), _linked(named)).toDF("var_ord", "root"))
    return held.join(roots.join(roots.join(odd, "var_ord").select("root").distinct(), "root", "left_semi"), "var_ord")


def _with_roots(weights: DataFrame, named: DataFrame) -> DataFrame:
    """weights(var_ord, weight[, root]) with the root of each component."""
    if "root" in weights.columns:
        return weights
    return weights.join(components(weights.select(F.col("var_ord").alias("node")), _linked(named)).toDF("var_ord", "root"), "var_ord")


def _most_coef(named: DataFrame) -> int:
    """The largest coefficient."""
    return int(named.agg(F.max(F.abs("coef"))).first()[0] or 1)


def solve_core(frame: pd.DataFrame, max_vars: int) -> pd.DataFrame:
    """frame: (root, kind, row, var_ord, coef, w, lo, hi), kinds as in solve_component, to (root, units,
    total, chosen)."""
    weights = frame[frame.kind == "w"].sort_values("var_ord")
    order = weights.var_ord.tolist()
    if len(order) > max_vars:
        raise ValueError(f"a component of which {len(order)} variables are left is no network and over the limit of {max_vars}")
    at = {v: k for k, v in enumerate(order)}
    rows: dict[str, tuple[dict[int, int], int, int]] = {}
    held = frame[frame.kind == "c"]
    for row, v, c, lo, hi in zip(held["row"].tolist(), held.var_ord.tolist(), held.coef.tolist(), held.lo.tolist(), held.hi.tolist(), strict=True):
        rows.setdefault(row, ({}, int(lo), int(hi)))[0][at[v]] = int(c)
    ends = frame[frame.kind == "s"]
    sink = {at[v]: int(c) for v, c in zip(ends.var_ord, ends.coef, strict=True)}
    out, values = [], [int(w) for w in weights.w.tolist()]
    for units in (0, 1) if sink else (0,):
        found = frontier(values, [*rows.values(), *([(sink, units, units)] if sink else [])])
        if found:
            out.append((frame.root.iloc[0], units, str(found[0]), [order[k] for k in found[1]]))
    return pd.DataFrame(out, columns=["root", "units", "total", "chosen"], dtype=object)


def _core_components(core: Reduced, max_vars: int, keep: Scratch) -> DataFrame:
    """What presolve left, each component in a task. A variable that no row and no sink holds is a
    component of its own, decided without one."""
    tied = keep(core.terms.select("var_ord").unionByName(core.ends.select("var_ord")).distinct())
    free = core.weights.join(tied, "var_ord", "left_anti").where("w > 0")
    single = free.select(F.col("var_ord").alias("root"), F.lit(0).alias("units"), F.col("w").cast("string").alias("total"), F.array("var_ord").alias("chosen"))
    weights = keep(core.weights.join(tied, "var_ord", "left_semi"))
    roots = keep(components(weights.select(F.col("var_ord").alias("node")), _linked(core.terms)).toDF("var_ord", "root"))
    nothing, none = F.lit(None), lambda *names: [F.lit(None).cast("long").alias(x) for x in names]
    parts = (
        weights.select(F.lit("w").alias("kind"), nothing.cast("string").alias("row"), "var_ord", *none("coef", "lo", "hi"), F.col("w").cast("string").alias("w"))
        .unionByName(core.terms.join(core.bounds, "row").select(F.lit("c").alias("kind"), "row", "var_ord", "coef", "lo", "hi", nothing.cast("string").alias("w")))
        .unionByName(core.ends.select(F.lit("s").alias("kind"), nothing.cast("string").alias("row"), "var_ord", "coef", *none("lo", "hi"), nothing.cast("string").alias("w")))
    )
    return parts.join(roots, "var_ord").groupBy("root").applyInPandas(lambda f: solve_core(f, max_vars), "root long, units int, total string, chosen array<long>").unionByName(single)


def _by_component(weights: DataFrame, named: DataFrame, ends: DataFrame, max_vars: int, shift: int) -> DataFrame:
    """The programs of weights(var_ord, weight, root), each component in a task."""
    roots, nothing = weights.select("var_ord", "root"), F.lit(None)
    parts = (
        weights.select(F.lit("w").alias("kind"), nothing.cast("string").alias("row"), "var_ord", nothing.cast("long").alias("coef"), "weight")
        .unionByName(named.select(F.lit("c").alias("kind"), "row", "var_ord", "coef", nothing.cast("double").alias("weight")))
        .unionByName(ends.select(F.lit("s").alias("kind"), nothing.cast("string").alias("row"), "var_ord", "coef", nothing.cast("double").alias("weight")))
    )
    return parts.join(roots, "var_ord").groupBy("root").applyInPandas(lambda f: solve_component(f, max_vars, shift), "root long, units int, total string, chosen array<long>")


def gains(arcs: DataFrame, prices: DataFrame) -> DataFrame:
    """arcs with r: what an arc gains beyond the prices of its ends."""
    at = lambda side: prices.toDF(side, f"p_{side}")
    big = "decimal(38,0)"
    r = F.col("w").cast(big) + F.coalesce("p_tail", F.lit(0).cast(big)) - F.coalesce("p_head", F.lit(0).cast(big))
    return arcs.join(at("tail"), "tail", "left").join(at("head"), "head", "left").select(*arcs.columns, r.cast(big).alias("r"))


def _told_apart(arcs: DataFrame, prices: DataFrame, enough: int, keep: Scratch, max_rounds: int = 20) -> tuple[DataFrame, int]:
    """arcs(arc, tail, head, w, x) with x that of the smallest of the equally heavy choices, and the
    most arcs that a task had to look at: those that may lie on a cycle without gain."""
    end = lambda c: F.when(F.col(c) == IN, F.lit(OUT)).otherwise(F.col(c))
    tied = gains(arcs, prices).where("r = 0").select("arc", end("tail").alias("tail"), end("head").alias("head"), "x")
    tied = keep(tied.withColumns({"a": F.when(F.col("x"), F.col("head")).otherwise(F.col("tail")), "b": F.when(F.col("x"), F.col("tail")).otherwise(F.col("head"))}))
    n = tied.count()
    for _ in range(max_rounds):
        if n <= enough:
            break
        left = keep(tied.join(tied.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(tied.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
        before, n, tied = n, left.count(), left
        if n == before:
            break
    if not n:
        return arcs, 0
    grouped = keep(_rooted(tied.select("arc", "tail", "head", "x"), n, enough, keep))
    most = grouped.groupBy("root").count().agg(F.max("count")).first()[0]
    turned = keep(grouped.groupBy("root").applyInPandas(smallest_arcs, "arc long"))
    if turned.isEmpty():
        return arcs, most
    return keep(arcs.join(turned.withColumn("t", F.lit(True)), "arc", "left").withColumn("x", F.when(F.col("t"), ~F.col("x")).otherwise(F.col("x"))).drop("t")), most


def _trimmed(chosen: DataFrame, weights: DataFrame, named: DataFrame, ends: DataFrame, keep: Scratch) -> DataFrame:
    """chosen without the last variables that weigh nothing and that the equations do not need: the
    shorter of two lists that start alike is the smaller. Looks only at variables of no weight after
    the last that weighs something."""
    weighed = chosen.join(weights, "var_ord")
    last = weighed.where("weight <> 0").agg(F.max("var_ord")).first()[0]
    tail = keep(weighed.where((F.col("weight") == 0) & (F.col("var_ord") > (-1 if last is None else last))).select("var_ord"))
    if tail.isEmpty():
        return chosen
    terms = named.unionByName(ends.select(F.lit(END).alias("row"), "var_ord", "coef")).join(tail, "var_ord")
    after = Window.partitionBy("row").orderBy(F.desc("var_ord"))
    spans = terms.select("row", F.col("var_ord").alias("high"), F.sum("coef").over(after).alias("off"), F.lead("var_ord").over(after).alias("low")).where("off <> 0")
    # from a variable after low up to high, dropping it and all behind it breaks the row
    events = spans.select((F.coalesce("low", F.lit(-1)) + 1).alias("at"), F.lit(1).alias("d")).unionByName(spans.select((F.col("high") + 1).alias("at"), F.lit(-1).alias("d")))
    marks = events.groupBy("at").agg(F.sum("d").alias("d")).unionByName(tail.select(F.col("var_ord").alias("at"), F.lit(0).cast("long").alias("d")))
    marks = marks.groupBy("at").agg(F.sum("d").alias("d"))
    running = marks.select("at", F.sum("d").over(Window.orderBy("at")).alias("open"))
    first = running.where("open = 0").join(tail.select(F.col("var_ord").alias("at")), "at", "left_semi").agg(F.min("at")).first()[0]
    return chosen if first is None else chosen.where(F.col("var_ord") < first)


def certificate(found: Solution, weights: DataFrame, equations: DataFrame, ends: DataFrame) -> DataFrame:
    """(var_ord, violation, gap): the proof that a network's solution is the best, worked out from the
    program itself and the solution's prices. A variable's gain is its weight (that of all variables
    an equation makes equal to it) less what its equations' prices ask. violation is what a chosen one
    loses or another one gains, or 1 where equal variables differ; gap is the difference between the
    choice's total and the prices' (the unit's price and all gains). Both are 0 exactly if the choice
    is the best. In units of the weights."""
    if found.prices is None:
        raise ValueError("only networks have a proof by prices")
    named = equations.select(F.concat_ws("|", "node_type", "node_id").alias("row"), "var_ord", F.col("coef").cast("long").alias("coef"))
    with Scratch(weights.sparkSession) as keep:
        return _certified(found, weights, keep(named), ends, keep)


def _certified(found: Solution, weights: DataFrame, named: DataFrame, ends: DataFrame, keep: Scratch) -> DataFrame:
    kind = keep(merged(named, keep))
    arc = F.coalesce("arc", "var_ord").alias("arc")
    held = weights.join(kind, "var_ord", "left").join(found.chosen.select("var_ord", F.lit(1).alias("x")), "var_ord", "left")
    held = keep(held.select("var_ord", arc, _scaled(found.shift)("weight").alias("w"), F.coalesce("x", F.lit(0)).alias("x")))
    sums = named.join(kind, "var_ord", "left").groupBy("row", arc).agg(F.sum("coef").alias("coef")).where("coef <> 0")
    sums = sums.unionByName(ends.select(F.lit(END).alias("row"), F.col("var_ord").alias("arc"), "coef"))
    asked = sums.join(found.prices.toDF("row", "price"), "row", "left").groupBy("arc").agg(F.sum(F.signum("coef").cast("int") * F.coalesce("price", F.lit(0).cast("decimal(38,0)"))).alias("asked"))
    whole_ = held.groupBy("arc").agg(F.sum("w").alias("w"), F.min("x").alias("least"), F.max("x").alias("most"))
    big = "decimal(38,0)"
    gain = whole_.join(asked, "arc", "left").select("arc", "w", "least", "most", (F.col("w") - F.coalesce("asked", F.lit(0).cast(big))).cast(big).alias("gain"))
    gain = keep(gain)
    off = F.when(F.col("least") != F.col("most"), F.lit(1)).when(F.col("most") == 1, F.greatest(-F.col("gain"), F.lit(0))).otherwise(F.greatest("gain", F.lit(0)))
    primal, dual = gain.agg(F.sum(F.when(F.col("most") == 1, F.col("w")).otherwise(0)), F.sum(F.greatest("gain", F.lit(0)))).first()
    end = found.prices.where(F.col("node") == END).first()["price"]
    gap = float(int(primal or 0) - int(dual or 0) - int(end)) / (1 << found.shift)
    one = F.lit(2.0**-found.shift if found.shift < 1000 else 1.0)
    return cut(held.join(gain.select("arc", off.cast("double").alias("off")), "arc").select("var_ord", (F.col("off") * one).alias("violation"), F.lit(gap).alias("gap")))
