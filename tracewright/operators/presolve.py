"""Programs that are no network, made small as tables before a task solves what is left.

All equations have right side 0, so choosing nothing is feasible: ranges of a row's sum always hold 0,
and a variable whose value is forced is 0. Each round looks at all rows and variables at once:

* a variable that would take its row out of its range goes; so does a row that no choice can break;
* variables that a row makes equal become one: the two of x = y, and those left of g * (...) = x + y + ...
  when only none or all of them make a multiple of g;
* of variables with the same coefficients in the same rows of which a row admits one at most, the
  heaviest stays, of equal ones the smallest number. Rows of two variables count as the same if they
  say the same of the other one;
* a variable in one equation only is what the rest of the equation leaves: the equation becomes a
  range and the weight moves to the others.

What was done is kept as tables and undone from the last step to the first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Scratch
from .components import components

BIG = "decimal(38,0)"
#: Variables in more rows than this are not looked at for equals: what is gathered for one stays small.
MOST_ROWS = 8


@dataclass
class Reduced:
    """weights(var_ord, w), terms(row, var_ord, coef), bounds(row, lo, hi) and ends(var_ord, coef) of
    what is left; steps to undo."""

    weights: DataFrame
    terms: DataFrame
    bounds: DataFrame
    ends: DataFrame
    steps: list[tuple[str, DataFrame]] = field(default_factory=list)
    rounds: int = 0

    def expanded(self, chosen: DataFrame, keep: Scratch) -> DataFrame:
        """The variables chosen of the whole program for chosen(var_ord) of the reduced one."""
        for kind, step in reversed(self.steps):
            if kind == "same":  # (var_ord, root)
                more = step.join(chosen.withColumnRenamed("var_ord", "root"), "root")
            else:  # (var_ord, of, coef)
                more = step.join(chosen.withColumnRenamed("var_ord", "of"), "of").groupBy("var_ord").agg(F.sum("coef").alias("x")).where("x = 1")
            chosen = keep(chosen.unionByName(more.select("var_ord")))
        return chosen


def _facts(terms: DataFrame, bounds: DataFrame) -> DataFrame:
    """A row's least and greatest sum, its range, and what tells the other one of two variables."""
    sizes = F.abs("coef")
    made = terms.groupBy("row").agg(
        F.count("*").alias("n"), F.sum(F.least("coef", F.lit(0))).alias("low"), F.sum(F.greatest("coef", F.lit(0))).alias("high"), F.min(sizes).alias("small"), F.max(sizes).alias("big"),
        F.min("var_ord").alias("v0"), F.max("var_ord").alias("v1"), F.min_by("coef", "var_ord").alias("c0"), F.max_by("coef", "var_ord").alias("c1"),
    )
    return made.join(bounds, "row")


def _ruled_out(terms: DataFrame, facts: DataFrame) -> DataFrame:
    """The variables that no choice within the rows' ranges holds."""
    c = F.col("coef")
    over = F.col("low") - F.least(c, F.lit(0)) + c > F.col("hi")
    under = F.col("high") - F.greatest(c, F.lit(0)) + c < F.col("lo")
    return terms.join(facts.select("row", "low", "high", "lo", "hi"), "row").where(over | under).select("var_ord")


def _rests(terms: DataFrame, facts: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """The variables of equations left over a multiple of the largest coefficient g: (var_ord) that
    are 0, as all of them together are less than g, and (a, b) that are equal, as all together are g."""
    left = keep(terms.join(facts.where("lo = 0 and hi = 0 and big > small").select("row", "big"), "row").where("coef % big <> 0"))
    sums = left.groupBy("row").agg(F.sum("coef").alias("s"), F.sum(F.abs("coef")).alias("a"), F.first("big").alias("g"), F.min("var_ord").alias("b"))
    sums = keep(sums.where("a = abs(s) and a <= g").select("row", "b", (F.col("a") == F.col("g")).alias("all")))
    both = left.join(sums, "row")
    return both.where(~F.col("all")).select("var_ord"), both.where("all and var_ord <> b").select(F.col("var_ord").alias("a"), "b")


def _equals(terms: DataFrame, weights: DataFrame, ends: DataFrame, facts: DataFrame, keep: Scratch) -> DataFrame:
    """The variables that an equal one outweighs where a row admits one at most."""
    few = terms.groupBy("var_ord").agg(F.count("*").alias("k")).where(F.col("k") <= MOST_ROWS).select("var_ord").join(ends.select("var_ord"), "var_ord", "left_anti")
    two, c = F.col("n") == 2, F.col("coef")
    other = F.when(F.col("var_ord") == F.col("v0"), F.struct(F.col("v1").alias("v"), F.col("c1").alias("c"))).otherwise(F.struct(F.col("v0").alias("v"), F.col("c0").alias("c")))
    of_two = F.when(two, F.struct(other.alias("other"), "lo", "hi"))
    says = F.struct(F.when(~two, F.col("row")).alias("row"), c.alias("c"), of_two.alias("two"))
    most = F.when(two, F.lit(None)).when(c > 0, F.floor((F.col("hi") - F.col("low")) / c)).otherwise(F.floor((F.col("high") - F.col("lo")) / -c))
    told = terms.join(few, "var_ord").join(facts, "row").groupBy("var_ord").agg(F.sort_array(F.collect_list(says)).alias("says"), F.min(most).alias("most"))
    told = keep(told.where("most <= 1").join(weights, "var_ord"))  # those that say the same have the same most
    best = told.groupBy("says").agg(F.count("*").alias("k"), F.max(F.struct("w", (-F.col("var_ord")).alias("v"))).alias("best"))
    best = best.where("k > 1").select("says", (-F.col("best.v")).alias("stays"))
    return told.join(best, "says").where("var_ord <> stays").select("var_ord")


def _slacks(terms: DataFrame, ends: DataFrame, facts: DataFrame, weights: DataFrame) -> DataFrame:
    """(row, v, c, wv): a variable of coefficient 1 or -1 in no other row, one for each equation."""
    alone = terms.groupBy("var_ord").agg(F.count("*").alias("k"), F.first("row").alias("row"), F.first("coef").alias("c")).where("k = 1 and abs(c) = 1")
    alone = alone.join(ends.select("var_ord"), "var_ord", "left_anti").join(facts.where("lo = 0 and hi = 0 and n > 1").select("row"), "row", "left_semi")
    one = alone.groupBy("row").agg(F.min(F.struct("var_ord", "c")).alias("one")).select("row", F.col("one.var_ord").alias("v"), F.col("one.c").alias("c"))
    return one.join(weights.toDF("v", "wv"), "v").select("row", "v", "c", "wv")


def reduced(weights: DataFrame, terms: DataFrame, ends: DataFrame, keep: Scratch, max_rounds: int = 100) -> Reduced:
    """weights(var_ord, w decimal), terms(row, var_ord, coef), each row with sum 0, ends(var_ord, coef).
    The best choice of what is left, for any number of units in the sink, expands to a best one of the
    whole. Stops when a round changes nothing; after ``max_rounds`` more is left, nothing is lost."""
    zero = F.lit(0).cast("long")
    bounds = keep(terms.select("row").distinct().select("row", zero.alias("lo"), zero.alias("hi")))
    out = Reduced(weights, terms, bounds, ends)
    while out.rounds < max_rounds:
        out.rounds += 1
        if not _round(out, keep):
            break
    return out


def _round(out: Reduced, keep: Scratch) -> bool:
    terms, bounds, weights, ends = out.terms, out.bounds, out.weights, out.ends
    facts = keep(_facts(terms, bounds))
    even = facts.where("lo = 0 and hi = 0 and small = big and big > 1").select("row", "big")
    idle = keep(facts.where("lo <= low and high <= hi").select("row"))
    none, equal = _rests(terms, facts, keep)
    zeros = keep(_ruled_out(terms, facts).unionByName(none).distinct())
    pairs = facts.where("n = 2 and lo = 0 and hi = 0 and c0 = -c1").select(F.col("v1").alias("a"), F.col("v0").alias("b"))
    links = keep(equal.unionByName(pairs).distinct())
    changed = not (idle.isEmpty() and zeros.isEmpty() and even.isEmpty())
    if not links.isEmpty():
        changed = True
        nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        same = keep(components(nodes, links).where("node <> root").select(F.col("node").alias("var_ord"), "root"))
        onto = lambda df: df.join(same, "var_ord", "left").withColumn("var_ord", F.coalesce("root", "var_ord")).drop("root")
        zeros = keep(onto(zeros).distinct())
        weights = onto(weights).groupBy("var_ord").agg(F.sum("w").cast(BIG).alias("w"))
        terms = onto(terms).groupBy("row", "var_ord").agg(F.sum("coef").alias("coef")).where("coef <> 0")
        ends = keep(onto(ends).groupBy("var_ord").agg(F.sum("coef").alias("coef")))
        out.steps.append(("same", same))
    if changed:
        terms = terms.join(zeros, "var_ord", "left_anti").join(idle, "row", "left_anti").join(even, "row", "left")
        terms = keep(terms.select("row", "var_ord", F.expr("coef div coalesce(big, 1)").alias("coef")))
        ends = keep(ends.join(zeros, "var_ord", "left_anti"))
        weights = keep(weights.join(zeros, "var_ord", "left_anti"))
        facts = keep(_facts(terms, bounds))

    light = keep(_equals(terms, weights, ends, facts, keep))
    if not light.isEmpty():
        changed = True
        terms, weights = keep(terms.join(light, "var_ord", "left_anti")), keep(weights.join(light, "var_ord", "left_anti"))
        facts = keep(_facts(terms, bounds))

    slack = keep(_slacks(terms, ends, facts, weights))
    if not slack.isEmpty():
        changed = True
        rest = keep(terms.join(slack, "row").where("var_ord <> v"))
        out.steps.append(("slack", keep(rest.select(F.col("v").alias("var_ord"), F.col("var_ord").alias("of"), (-F.col("c") * F.col("coef")).alias("coef")))))
        moved = rest.select("var_ord", (-(F.col("c") * F.col("coef")).cast(BIG) * F.col("wv")).cast(BIG).alias("w"))
        gone = slack.select(F.col("v").alias("var_ord"))
        weights = keep(weights.join(gone, "var_ord", "left_anti").unionByName(moved).groupBy("var_ord").agg(F.sum("w").cast(BIG).alias("w")))
        terms = keep(terms.join(gone, "var_ord", "left_anti"))
        wide = slack.select("row", F.when(F.col("c") == 1, -1).otherwise(0).cast("long").alias("l"), F.when(F.col("c") == 1, 0).otherwise(1).cast("long").alias("h"))
        bounds = keep(bounds.join(wide, "row", "left").select("row", F.coalesce("l", "lo").alias("lo"), F.coalesce("h", "hi").alias("hi")))
    out.terms, out.bounds, out.weights, out.ends = terms, bounds, weights, ends
    return changed


def _in_turn(of: list[list[tuple[int, int]]], rows: list[tuple[dict[int, int], int, int]]) -> list[int]:
    """An order of the variables in which few rows are begun and not ended at any time."""
    left, begun, done, order = [len(r[0]) for r in rows], [False] * len(rows), [False] * len(of), []

    def cost(v: int) -> tuple[int, int, int]:
        opens, ends = sum(not begun[r] for r, _ in of[v]), sum(left[r] == 1 for r, _ in of[v])
        return opens - ends, min((left[r] for r, _ in of[v]), default=0), v

    heap = [(cost(v), v) for v in range(len(of))]
    heapify(heap)
    while heap:
        was, v = heappop(heap)
        if done[v]:
            continue
        now = cost(v)
        if now > was:
            heappush(heap, (now, v))
            continue
        done[v] = True
        order.append(v)
        near = {u for r, _ in of[v] if not begun[r] or left[r] < 64 for u in rows[r][0]}
        for r, _ in of[v]:
            begun[r], left[r] = True, left[r] - 1
        for u in near:
            if not done[u]:
                heappush(heap, (cost(u), u))
    return order


def frontier(weights: list[int], rows: list[tuple[dict[int, int], int, int]], most_states: int = 500_000) -> tuple[int, list[int]] | None:
    """The best 0/1 choice with each row's sum (coefficients by variable) in its range, or None: the
    variables are taken in turn, and of choices so far that agree in the sums of all begun rows only
    the best is kept. Takes as many states as the begun rows have sums, whatever the number of
    variables; beyond ``most_states`` it gives up."""
    of: list[list[tuple[int, int]]] = [[] for _ in weights]
    for r, (coefs, _, _) in enumerate(rows):
        for v, c in coefs.items():
            of[v].append((r, c))
    if any(not coefs and not lo <= 0 <= hi for coefs, lo, hi in rows):
        return None
    low, high = [sum(min(0, c) for c in r[0].values()) for r in rows], [sum(max(0, c) for c in r[0].values()) for r in rows]
    left = [len(r[0]) for r in rows]
    begun: list[int] = []
    states: dict[tuple[int, ...], tuple[int, tuple | None]] = {(): (0, None)}
    for v in _in_turn(of, rows):
        at = {r: k for k, r in enumerate(begun)}
        for r, c in of[v]:
            low[r], high[r], left[r] = low[r] - min(0, c), high[r] - max(0, c), left[r] - 1
        begun = [r for r in (*begun, *(r for r, _ in of[v] if r not in at)) if left[r]]
        own = dict(of[v])
        takes = [(at.get(r, -1), own.get(r, 0)) for r in begun]
        tests = [(at.get(r, -1), c, rows[r][1] - high[r], rows[r][2] - low[r]) for r, c in of[v]]
        after: dict[tuple[int, ...], tuple[int, tuple | None]] = {}
        for sums, (total, chosen) in states.items():
            for x in (1, 0):
                if any(not lo <= (sums[k] if k >= 0 else 0) + c * x <= hi for k, c, lo, hi in tests):
                    continue
                new = tuple([(sums[k] if k >= 0 else 0) + c * x for k, c in takes])
                worth = total + weights[v] * x
                if new not in after or worth > after[new][0]:
                    after[new] = (worth, (v, chosen) if x else chosen)
        states = after
        if len(states) > most_states:
            raise ValueError(f"over {most_states} sums of begun rows: what is left of the program hangs together too closely")
    if () not in states:
        return None
    total, chain = states[()]
    chosen = []
    while chain:
        chosen.append(chain[0])
        chain = chain[1]
    return total, sorted(chosen)
