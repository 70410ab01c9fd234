"""Selection programs that are networks, as tables of arcs: built, contracted and expanded again.

The rules are those of ``network``, applied to all arcs at once by joins. A node with one way out
goes where that way leads if the far node has one way out too, or if it has one way in itself; the
same backwards. Ends of chains go in even passes; in odd ones a coin tells which of neighbours goes,
so that a long chain halves with each pass. Of parallel arcs between ends that carry one unit the two
heaviest stay: one of them is left out by any flow, and its price then holds for those that were
dropped. Every step keeps which arc follows from which and which node took its price from which, so a
choice and its prices on the contracted arcs become those of all arcs by a join for each step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.lineage import Scratch
from .components import components

#: Names of the nodes outside the equations; equations' names hold a bar.
OUT, IN, END = "source", "drain", "sink"


def _special(node: str) -> Column:
    return F.col(node).isin(OUT, IN, END)


@dataclass
class Arcs:
    """arcs(arc, tail, head, w): an arc's number is its smallest variable. kind(var_ord, arc): the
    variables that stand for more than themselves or are stood for. odd(var_ord): variables of
    equations that are no balance of arcs."""

    arcs: DataFrame
    kind: DataFrame
    odd: DataFrame


def merged(named: DataFrame, keep: Scratch) -> DataFrame:
    """named(row, var_ord, coef) to (var_ord, arc): variables that an equation makes equal."""
    signs = named.groupBy("row").agg(
        F.count(F.when(F.col("coef") > 0, 1)).alias("n"),
        F.max("coef").alias("most"),
        F.min("coef").alias("least"),
        F.max(F.when(F.col("coef") < 0, F.col("coef"))).alias("near"),
    )
    equal = signs.where("n > 1 and most = 1 and least = -n and near = -n").select("row")
    plus = keep(named.join(equal, "row").where("coef > 0").select("row", "var_ord"))
    first = plus.groupBy("row").agg(F.min("var_ord").alias("arc"))
    links = plus.join(first, "row").select("var_ord", "arc")
    if links.groupBy("var_ord").count().where("count > 1").isEmpty():
        return links
    nodes = links.select(F.col("var_ord").alias("node")).unionByName(links.select(F.col("arc").alias("node"))).distinct()
    return components(nodes, links.toDF("a", "b")).toDF("var_ord", "arc")


def built(weights: DataFrame, named: DataFrame, ends: DataFrame, keep: Scratch) -> Arcs:
    """weights(var_ord, w), named(row, var_ord, coef), ends(var_ord, coef)."""
    kind = keep(merged(named, keep))
    arc = F.coalesce("arc", "var_ord").alias("arc")
    sums = named.join(kind, "var_ord", "left").select("row", arc, "coef").groupBy("row", "arc").agg(F.sum("coef").alias("coef")).where("coef <> 0")
    sums = keep(sums)
    uneven = sums.groupBy("row").agg(F.max(F.abs("coef")).alias("x"), F.min(F.abs("coef")).alias("y")).where("x <> y").select("row")
    sides = sums.groupBy("arc").agg(
        F.count(F.when(F.col("coef") > 0, 1)).alias("n_in"),
        F.count(F.when(F.col("coef") < 0, 1)).alias("n_out"),
        F.max(F.when(F.col("coef") > 0, F.col("row"))).alias("head"),
        F.max(F.when(F.col("coef") < 0, F.col("row"))).alias("tail"),
    )
    many = kind.groupBy("arc").agg(F.count("*").alias("n_vars"))
    last = ends.join(kind, "var_ord", "left").select(arc, F.col("coef").alias("units"))
    last = last.groupBy("arc").agg(F.max("units").alias("units"), F.count("*").alias("n_ends"))
    held = weights.join(kind, "var_ord", "left").select(arc, "w").groupBy("arc").agg(F.sum("w").alias("w"))
    rows = held.join(sides, "arc", "left").join(many, "arc", "left").join(last, "arc", "left")
    wrong = (F.col("n_in") > 1) | (F.col("n_out") > 1) | ((F.col("units").isNotNull()) & ((F.col("units") != 1) | (F.col("n_ends") > 1) | F.col("head").isNotNull() | (F.coalesce("n_vars", F.lit(1)) > 1)))
    head = F.when(F.col("units").isNotNull(), F.lit(END)).otherwise(F.coalesce("head", F.lit(IN)))
    rows = keep(rows.select("arc", F.coalesce("tail", F.lit(OUT)).alias("tail"), head.alias("head"), "w", F.coalesce(wrong, F.lit(False)).alias("wrong")))
    odd = named.join(uneven, "row", "left_semi").select("var_ord").unionByName(rows.where("wrong").select(F.col("arc").alias("var_ord")))
    return Arcs(rows.drop("wrong"), kind, odd)


@dataclass
class Step:
    """taken(node, far, o, wo): nodes that went and the arc that they went along; follows(arc, o)."""

    taken: DataFrame
    follows: DataFrame
    back: bool


def _ways(arcs: DataFrame) -> DataFrame:
    """(node, n_out, n_in)"""
    ends = arcs.select(F.col("tail").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(arcs.select(F.col("head").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.where(~_special("node")).groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def _joined(arcs: DataFrame, back: bool, turn: int, keep: Scratch) -> tuple[DataFrame, Step | None]:
    a, b = ("head", "tail") if back else ("tail", "head")
    one, ways = ("n_in", "n_out") if back else ("n_out", "n_in")
    known = keep(_ways(arcs))
    single = known.where(F.col(one) == 1)
    goes = arcs.where(~_special(a) & (F.col(a) != F.col(b))).join(single.select(F.col("node").alias(a), ways), a)
    goes = goes.join(single.select(F.col("node").alias(b), F.lit(True).alias("alone")), b, "left").where((F.col(ways) == 1) | F.col("alone"))
    goes = keep(goes.select(F.col(a).alias("node"), F.col(b).alias("far"), F.col("arc").alias("o"), F.col("w").alias("wo")))
    also = goes.select(F.col("node").alias("far"), F.lit(True).alias("also"))
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 1
    rule = F.col("also").isNull() if turn % 2 == 0 else coin("node") & (F.col("also").isNull() | ~coin("far"))
    taken = keep(goes.join(also, "far", "left").where(rule).select("node", "far", "o", "wo"))
    if taken.isEmpty():
        return arcs, None
    moved = arcs.join(taken.select(F.col("o").alias("arc")), "arc", "left_anti").join(taken.withColumnRenamed("node", b), b, "left")
    moved = keep(moved.select("arc", F.col(a), F.coalesce("far", b).alias(b), (F.col("w") + F.coalesce("wo", F.lit(0))).cast(arcs.schema["w"].dataType).alias("w"), "o"))
    return moved.select("arc", "tail", "head", "w"), Step(taken, moved.where("o is not null").select("arc", "o"), back)


def _pruned(arcs: DataFrame, keep: Scratch) -> DataFrame:
    carry = _ways(arcs).where("least(n_out, n_in) <= 1").select("node", F.lit(True).alias("thin"))
    marked = arcs.join(carry.toDF("tail", "t"), "tail", "left").join(carry.toDF("head", "h"), "head", "left")
    marked = marked.withColumn("thin", F.coalesce("t", "h", F.lit(False))).drop("t", "h")
    place = F.row_number().over(Window.partitionBy("tail", "head").orderBy(F.desc("w"), "arc"))
    kept = marked.where("thin").withColumn("k", place).where("k <= 2")  # tasks keep two before the shuffle
    columns = ["arc", "tail", "head", "w"]
    return keep(marked.where("not thin").select(*columns).unionByName(kept.select(*columns)))


@dataclass
class Contracted:
    """arcs(arc, tail, head, w) as few as they came to be, and the steps there."""

    arcs: DataFrame
    n: int
    steps: list[Step] = field(default_factory=list)

    def expanded(self, chosen: DataFrame, keep: Scratch) -> DataFrame:
        """chosen(arc) of the contracted arcs to that of all."""
        for step in reversed(self.steps):
            chosen = keep(chosen.unionByName(step.follows.join(chosen, "arc").select(F.col("o").alias("arc"))))
        return chosen

    def priced(self, prices: DataFrame, keep: Scratch) -> DataFrame:
        """prices(node, price) of the contracted nodes, the special ones among them, to that of all."""
        zero = F.lit(0)
        for step in reversed(self.steps):
            sign = 1 if step.back else -1
            far = step.taken.join(prices.toDF("far", "p"), "far", "left")
            kind = prices.schema["price"].dataType
            prices = keep(prices.unionByName(far.select("node", (F.coalesce("p", zero) + sign * F.col("wo")).cast(kind).alias("price"))))
        return prices


def contracted(arcs: DataFrame, enough: int, keep: Scratch, max_passes: int = 60) -> Contracted:
    """arcs until they are at most ``enough`` or two passes save less than a twentieth."""
    out = Contracted(arcs, arcs.count())
    sizes = [out.n]
    for turn in range(max_passes):
        if out.n <= enough or (len(sizes) > 2 and sizes[-1] > 0.95 * sizes[-3]):
            break
        for back in (False, True):
            out.arcs, step = _joined(out.arcs, back, turn, keep)
            if step:
                out.steps.append(step)
        out.arcs = _pruned(out.arcs, keep)
        out.n = out.arcs.count()
        sizes.append(out.n)
    return out
