"""A node's timeline: what it came from and what it led to, as reachable sets.

A hyperedge is crossed as a point of its own (source to edge, edge to its sources and its
destination), which is linear in its sources; pairs of sources are never built. Each round joins
the nodes found last with the incidences for a few steps, drops what is known and is cut to the
shared folder, so the work does not grow with the number of paths to a node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import Scratch, cut, stored

NODE = ["node_id", "node_type"]


def _start(df: DataFrame, node_id: str, node_type: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(node_id, node_type)], "node_id string, node_type string")


def _closure(start: DataFrame, step, max_rounds: int, burst: int = 4) -> DataFrame:
    """(node_id, node_type, depth): start at depth 0 and all that step reaches. A round takes
    ``burst`` steps before it drops what is known, so a deep graph needs few jobs; a node's depth is
    the least of those at which it was met."""
    found = last = cut(start.withColumn("depth", F.lit(0)))
    for done in range(0, max_rounds, burst):
        at, new = last.select(*NODE), None
        for depth in range(done + 1, done + burst + 1):
            at = step(at).distinct()
            met = at.withColumn("depth", F.lit(depth))
            new = met if new is None else new.unionByName(met)
        new = cut(new.groupBy(*NODE).agg(F.min("depth").alias("depth")).join(found.select(*NODE), NODE, "left_anti"))
        found = found.unionByName(new)
        last = new.where(F.col("depth") == done + burst)
        if last.isEmpty():
            return found
        if done // burst % 16 == 15:
            found = cut(found)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def backward(rows: DataFrame, node_id: str, node_type: str, max_rounds: int = 10_000) -> DataFrame:
    """The node and all nodes it came from: destination to sources."""
    up = rows.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), "src", "src_type")

    def step(last: DataFrame) -> DataFrame:
        return up.join(last, NODE).select(F.col("src").alias("node_id"), F.col("src_type").alias("node_type"))

    return _closure(_start(rows, node_id, node_type), step, max_rounds)


#: Counts of paths have as many digits as they need: limbs of 18 digits, the lowest first.
LIMB = 18


def _carried(df: DataFrame, limbs: int) -> DataFrame:
    """Limbs below 10^18 again, with one limb more for what the last one carries."""
    base, carry, out = F.lit(10**LIMB).cast("decimal(38,0)"), None, []
    for k in range(limbs):
        full = F.col(f"n{k}") if carry is None else (F.col(f"n{k}") + F.col("_carry")).cast("decimal(38,0)")
        df = df.withColumn("_full", full).withColumn("_carry", F.expr("_full div 1000000000000000000").cast("decimal(38,0)"))
        df = df.withColumn(f"n{k}", (F.col("_full") % base).cast("decimal(38,0)"))
        carry = True
        out.append(f"n{k}")
    return df.withColumn(f"n{limbs}", F.col("_carry")).select(*NODE, *out, f"n{limbs}")


def _added(df: DataFrame, limbs: int) -> DataFrame:
    """One row for each node, with the sum of its counts: limbs + 1 limbs."""
    return _carried(df.groupBy(*NODE).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(limbs)]), limbs)


def _limbs(df: DataFrame) -> int:
    """How many limbs df has."""
    return len(df.columns) - len(NODE) - ("depth" in df.columns)


def _widened(df: DataFrame, limbs: int) -> DataFrame:
    return df.select("*", *[F.lit(0).cast("decimal(38,0)").alias(f"n{k}") for k in range(_limbs(df), limbs)])


def _slim(df: DataFrame) -> DataFrame:
    """df without the highest limbs that are 0 in every row."""
    limbs = _limbs(df)
    most = df.agg(*[F.max(f"n{k}").alias(f"n{k}") for k in range(limbs)]).first()
    used = max([k for k in range(limbs) if most[k]], default=0)
    return df.drop(*[f"n{k}" for k in range(used + 1, limbs)])


def path_counts(rows: DataFrame, node_id: str, node_type: str, max_rounds: int = 10_000, burst: int = 4) -> DataFrame:
    """(node_id, node_type, n0, n1 ...): how many paths lead back to each node, the start with its one
    among them, in limbs of 18 digits, the lowest first: numbers of any length. Paths are counted, not
    walked, so the work goes by the steps of the graph. Cycles raise."""
    up = rows.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), "src", "src_type")
    last = _start(rows, node_id, node_type).withColumn("n0", F.lit(1).cast("decimal(38,0)"))
    found = last
    for done in range(0, max_rounds, burst):
        at, limbs, new = last, _limbs(last), []
        for depth in range(done + 1, done + burst + 1):
            met = up.join(at, NODE).drop(*NODE).withColumnsRenamed({"src": "node_id", "src_type": "node_type"})
            at, limbs = _added(met, limbs), limbs + 1  # fewer than 10^18 rows are added up: one limb more holds the sum
            new.append(at.withColumn("depth", F.lit(depth)))
        new = stored(reduce(DataFrame.unionByName, [_widened(df, limbs).select(*NODE, "depth", *[f"n{k}" for k in range(limbs)]) for df in new]))
        new = _slim(new)
        limbs = max(_limbs(new), _limbs(found))
        last = new.where(F.col("depth") == done + burst).drop("depth")
        found = _widened(found, limbs).unionByName(_widened(new.drop("depth"), limbs))
        if last.isEmpty():
            return _slim(stored(_added(found, limbs)))
        if done // burst % 16 == 15:
            found = _slim(stored(_added(found, limbs)))
    raise RuntimeError(f"no end after {max_rounds} rounds")


def written_counts(counts: DataFrame) -> DataFrame:
    """(node_id, node_type, n_paths): counts of paths as decimal digits."""
    limbs = range(_limbs(counts) - 1, -1, -1)
    digits = F.concat(*[F.lpad(F.col(f"n{k}").cast("string"), LIMB, "0") for k in limbs])
    return counts.select(*NODE, F.regexp_replace(digits, "^0+(?=[0-9])", "").alias("n_paths"))


def backward_paths(rows: DataFrame, node_id: str, node_type: str, max_rounds: int = 10_000, burst: int = 4) -> DataFrame:
    """(node_id, node_type, n_paths): ``path_counts`` as numbers of at most 38 digits; more raise.
    How often a walk meets a node that keeps no note of where it was."""
    counts = written_counts(path_counts(rows, node_id, node_type, max_rounds, burst))
    long = F.raise_error(F.lit("more than 38 digits: take path_counts")).cast("decimal(38,0)")
    return counts.withColumn("n_paths", F.when(F.length("n_paths") > 38, long).otherwise(F.col("n_paths").cast("decimal(38,0)")))


def forward(rows: DataFrame, node_id: str, node_type: str, max_rounds: int = 10_000) -> DataFrame:
    """The node and all nodes it led to: source to its edge, and the edge to its other sources and
    its destination."""
    entry = rows.select(F.col("src").alias("node_id"), F.col("src_type").alias("node_type"), "edge_ord")
    exits = cut(entry.unionByName(rows.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), "edge_ord").distinct()))

    def step(last: DataFrame) -> DataFrame:
        return exits.join(entry.join(last, NODE).select("edge_ord").distinct(), "edge_ord").select(*NODE)

    return _closure(_start(rows, node_id, node_type), step, max_rounds)


def timeline(rows: DataFrame, node_id: str, node_type: str = "model") -> DataFrame:
    """(node_id, node_type, direction, depth): what is behind the node, without it, and what is
    ahead, with it."""
    behind = backward(rows, node_id, node_type).where("depth > 0").withColumn("direction", F.lit("backward"))
    ahead = forward(rows, node_id, node_type).withColumn("direction", F.lit("forward"))
    return behind.unionByName(ahead).select(*NODE, "direction", "depth")


def model_timeline(rows: DataFrame, node_id: str, node_type: str = "model", as_shipped: bool = False) -> DataFrame:
    """(node_id): the model nodes of a timeline. as_shipped gives the asked id instead, once for
    each path back to a model and once for each model ahead, as the service it stands for does; its
    rows grow with the paths, which backward_paths counts."""
    if not as_shipped:
        return timeline(rows, node_id, node_type).where("node_type = 'model'").select("node_id")
    start = (F.col("node_id") == node_id) & (F.col("node_type") == node_type)
    behind = backward_paths(rows, node_id, node_type).where(~start & (F.col("node_type") == "model"))
    # rows of a thousand paths first: one array of them all may be too long
    dealt = behind.select(F.col("n_paths").cast("long").alias("n")).selectExpr("n", "explode(sequence(0L, (n - 1) div 1000)) AS part").selectExpr("explode(sequence(1L, least(1000L, n - part * 1000))) AS k")
    ahead = forward(rows, node_id, node_type).where("node_type = 'model'")
    return dealt.select(F.lit(node_id).alias("node_id")).unionByName(ahead.select(F.lit(node_id).alias("node_id")))


def backward_walk(rows: DataFrame, node_id: str, node_type: str, max_rounds: int = 10_000) -> DataFrame:
    """(ordinal, node_id, node_type): the walk back from a node in order, as one meets the nodes who
    goes to each source in turn (edges in build order, sources by position), back from it first, and
    keeps no note of where they were. A node's rows are as many as its paths (``backward_paths``).

    Nobody walks: the part of the walk below a node is as long whichever way led there, so a source
    stands a fixed way after its destination, by running sums over the parts before it. Sizes are
    added up from the ends, then places are handed down a step at a time. Cycles raise."""
    up = rows.select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"), F.col("src").alias("src"), "src_type", "var_ord")
    with Scratch(rows.sparkSession) as keep:
        here = keep(backward(rows, node_id, node_type, max_rounds).select(*NODE))
        steps = keep(up.join(here, NODE))
        sized = keep(here.join(steps.select(*NODE).distinct(), NODE, "left_anti").withColumn("size", F.lit(1).cast("long")))
        left = keep(here.join(sized, NODE, "left_anti"))
        source = sized.columns
        for _ in range(max_rounds):
            if left.isEmpty():
                break
            under = steps.join(left, NODE, "left_semi").join(sized.toDF("src", "src_type", "below"), ["src", "src_type"], "left")
            ready = under.groupBy(*NODE).agg(F.count(F.when(F.col("below").isNull(), 1)).alias("open"), (F.sum("below") + 1).alias("size")).where("open = 0")
            ready = keep(ready.select(*source))
            if ready.isEmpty():
                raise ValueError("the walk does not end: there is a cycle")
            sized, left = keep(sized.unionByName(ready)), keep(left.join(ready, NODE, "left_anti"))
        # the places of a destination's sources after it
        sizes = steps.join(sized.toDF("src", "src_type", "below"), ["src", "src_type"])
        before = Window.partitionBy(*NODE).orderBy("var_ord").rowsBetween(Window.unboundedPreceding, -1)
        offsets = keep(sizes.select(*NODE, "src", "src_type", (F.coalesce(F.sum("below").over(before), F.lit(0)) + 1).alias("after")))
        last = keep(_start(rows, node_id, node_type).withColumn("ordinal", F.lit(0).cast("long")))
        found = [last]
        for _ in range(max_rounds):
            last = keep(last.join(offsets, NODE).select(F.col("src").alias("node_id"), F.col("src_type").alias("node_type"), (F.col("ordinal") + F.col("after")).alias("ordinal")))
            if last.isEmpty():
                break
            found.append(last)
        return cut(reduce(DataFrame.unionByName, found).select("ordinal", *NODE))
