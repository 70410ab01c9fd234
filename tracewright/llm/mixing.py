"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target in words; a document's expected number of copies is target over source
size, the same for all documents of the source. Its whole part is taken for sure. The fractional
parts are rounded in pairs: mass, counted in words, moves from one document to the other, up or
down at random so that expectations hold, until one of the two probabilities is 0 or 1. The words
that a source is expected to give never change on the way.

The pairs form a tree: documents are dealt by hash into groups of about ``fan_in``; each group is
folded in one pass and leaves at most one undecided document, and these are the next level's input,
so a source with a third of all rows is as many groups as it needs, on all machines. The last
document of a source is paired with a decided one of fitting size, whose decision turns, so what is
missing in the end is a few words. Chance comes from hashes of ids and a seed: the same table gives
the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, free_name, n_words, row_key, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def _before(rows: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """rows with, for each name=column, the column's sum over all rows before this one in a total
    order. Rows are range-partitioned and summed inside their partition; one row for each partition
    holds what came before it, so no task sees all rows. Sums of whole numbers are exact."""
    (part,) = free_name(rows, "part")
    ranged = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    parts = ranged.groupBy(part).agg(*[F.sum(c).alias(f"{n}_part") for n, c in sums.items()])
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.select(part, *[F.coalesce(F.sum(f"{n}_part").over(ahead), F.lit(0.0)).alias(f"{n}_part") for n in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for n, c in sums.items()}).join(F.broadcast(parts), part)
    return found.withColumns({n: F.col(n) + F.col(f"{n}_part") for n in sums}).drop(part, *[f"{n}_part" for n in sums])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sized(source, size) to (source, source_size, n, target). Sources by code point, null last,
    take the weights in turn and share all words; a target above most times its source's size stops
    there and the excess is shared again. Filling in the order of size over weight reaches the same
    end in one pass over the sources, of which there may be very many (hosts)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = sources.select("source", "source_size", "n", F.col("source").isNull().alias("none"), F.lit(1.0).alias("one"))
    sources = _before(sources, ["none", "source"], turn="one")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * F.lit(float(most))
    sources = sources.withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    sources = cut(_before(sources, ["level", "none", "source"], cap_before="cap", weight_before="weight"))
    whole = sources.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("weights"))
    sources = sources.join(F.broadcast(whole))  # one row
    sources = sources.withColumn("fill", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    full = F.col("level") <= F.col("fill")
    open_level = sources.agg(F.min_by(F.when(~full, F.col("fill")), F.when(~full, F.col("level"))).alias("open_level"))
    sources = sources.join(F.broadcast(open_level))  # one row
    return sources.select("source", "source_size", "n", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.col("open_level")).alias("target"))


def _chance(*of: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _pair(level: int, seed: int):
    """The fold's step: the undecided document of the state meets the next one."""

    def step(state: Column, x: Column) -> Column:
        at = state["open"]
        a, p, b, q = at["size"], at["p"], x["size"], x["p"]
        rise = F.least((1 - p) * a, q * b)  # words that can move to the first
        fall = F.least(p * a, (1 - q) * b)
        u = _chance(at["id"], at["t"], at["copy"], x["id"], x["t"], x["copy"], F.lit(level), F.lit(seed))
        up = u * (rise + fall) < fall
        first = F.when(up, F.when((1 - p) * a <= q * b, F.lit(1.0)).otherwise(p + q * b / a)).otherwise(
            F.when(p * a <= (1 - q) * b, F.lit(0.0)).otherwise(p - (1 - q) * b / a)
        )
        second = F.when(up, F.when((1 - p) * a >= q * b, F.lit(0.0)).otherwise(q - (1 - p) * a / b)).otherwise(
            F.when(p * a >= (1 - q) * b, F.lit(1.0)).otherwise(q + p * a / b)
        )
        settled = (p <= 0) | (p >= 1)
        one = F.when(settled, p).otherwise(first)
        two = F.when(settled, q).otherwise(second)
        one_done = (one <= 0) | (one >= 1)

        def unit(of: Column, chance: Column) -> Column:
            return F.struct(of["h"].alias("h"), of["id"].alias("id"), of["t"].alias("t"), of["copy"].alias("copy"), of["size"].alias("size"), chance.alias("p"))

        done = F.when(one_done, unit(at, one)).otherwise(unit(x, two))
        left = F.when(one_done, unit(x, two)).otherwise(unit(at, one))
        return F.struct(left.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))

    return step


def decide(docs: DataFrame, fan_in: int = 64, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs(doc_id, source, size and, if it has it, t: a hash of the text) to one row per row: these,
    source_size, target, copy (which of the rows with equal values), whole, extra (0 or 1). Its
    copies are whole + extra. Pairs meet in the order of hashes of these values; equal rows differ
    in their copy number, so ties never depend on where a row was read."""
    sized = cut(docs if "t" in docs.columns else docs.withColumn("t", F.lit(0).cast("long")))
    aims = cut(targets(sized, weights, most))
    top = aims.agg(F.max("n")).first()[0] or 0
    classes = sized.groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("m"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("whole", F.floor(rate).cast("int")).withColumn("part", rate - F.floor(rate))
    named = bounded(aims.withColumnRenamed("source", "its"))
    units = (
        classes.join(named, F.col("source").eqNullSafe(F.col("its")))
        .drop("its")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
        .drop("m")
    )
    fixed = ["source", "source_size", "target", "whole"]
    named_row = ["doc_id", "size", "t", "copy"]
    certain = (F.col("part") <= 0) | (F.col("size") <= 0)
    certainly, out = units.where(certain).select(*named_row, *fixed, F.lit(0).alias("extra")), None
    opened = units.where(~certain).select(
        *fixed, F.struct(row_key(F.col("doc_id"), F.col("source"), F.col("size"), F.col("t"), F.col("copy"), F.lit(seed))[0].alias("h"), F.col("doc_id").alias("id"), "t", "copy", F.col("size").cast("double").alias("size"), F.col("part").alias("p")).alias("x"), F.col("n").cast("double").alias("n")
    )
    level, left = 0, top
    while left > 1 or level == 0:
        groups = F.ceil(F.col("n") / fan_in).cast("long")
        dealt = opened.withColumn("g", F.pmod(F.xxhash64("x.h", F.lit(level)), groups)).groupBy(*fixed, "n", "g").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        state = F.aggregate(
            F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))),
            F.struct(F.element_at("xs", 1).alias("open"), F.slice("xs", 1, 0).alias("done")),
            _pair(level, seed),
        )
        folded = cut(dealt.select(*fixed, groups.cast("double").alias("n"), state.alias("s")).select(*fixed, "n", "s.open", "s.done"))
        settled = (F.col("open.p") <= 0) | (F.col("open.p") >= 1)
        done = folded.select(*fixed, F.explode(F.when(settled, F.concat("done", F.array("open"))).otherwise(F.col("done"))).alias("x"))
        done = _taken(done, fixed, F.col("x.p").cast("int"))
        out = out.unionByName(done) if out else done
        opened = folded.where(~settled).select(*fixed, F.col("open").alias("x"), "n")
        left, level = -(-left // fan_in), level + 1
    return certainly.unionByName(_last(out, _taken(opened, fixed, F.lit(0)).join(opened.select(F.col("x.h").alias("h"), F.col("x.p").alias("p")), "h"), seed))


def _last(done: DataFrame, left: DataFrame, seed: int, rounds: int = 24) -> DataFrame:
    """The undecided document of each source against decided ones that can give or take its words:
    it drops to 0 and a document of about p times its size is taken instead, or it rises to 1 and a
    document of about the rest of its size goes, with the chances that keep expectations. What one
    document leaves open goes to the next, until none is nearer than none, every source is within a
    ten-thousandth of its target, or `rounds` documents of a source have turned."""
    up = _chance("h", F.lit(-1), F.lit(seed)) < F.col("p")
    left = cut(left.withColumn("extra", F.when(up, 1).otherwise(0)))
    fits = F.col("source").eqNullSafe(F.col("its")) & (F.col("extra") == F.when(F.col("due") > 0, 0).otherwise(1))
    miss = F.abs(F.col("size") - F.abs("due"))
    due = cut(left.select(F.col("source").alias("its"), ((F.col("p") - F.col("extra")) * F.col("size")).alias("due"), F.col("target").alias("aim")))
    turned, here = None, done
    for _ in range(rounds):  # a row for each source
        partner = here.join(bounded(due), fits).where(miss < F.abs("due")).groupBy("its").agg(F.min(F.struct(miss.alias("miss"), "h", "size")).alias("x"))
        due = due.withColumnRenamed("its", "of").join(partner, F.col("of").eqNullSafe(F.col("its")), "left")
        size = F.coalesce("x.size", F.lit(0))
        due = cut(due.select(F.col("of").alias("its"), (F.col("due") - F.signum("due") * size).alias("due"), "aim", F.col("x.h").alias("h")))
        found = due.where("h is not null").select("h", F.lit(True).alias("turned"))
        turned = found if turned is None else turned.unionByName(found)
        here = done.join(turned, "h", "left_anti")
        state = due.agg(F.count("h").alias("n"), F.max(F.abs("due") / F.greatest("aim", F.lit(1.0))).alias("off")).first()
        due = due.drop("h")
        if not state["n"] or state["off"] < 1e-4:
            break
    done = done.join(turned, "h", "left").withColumn("extra", F.when(F.col("turned"), 1 - F.col("extra")).otherwise(F.col("extra")))
    names = [c for c in left.columns if c not in ("h", "p")]
    return done.select(*names).unionByName(left.select(*names))


def _taken(rows: DataFrame, fixed: list[str], extra: Column) -> DataFrame:
    return rows.select(F.col("x.id").alias("doc_id"), F.col("x.size").cast("long").alias("size"), F.col("x.t").alias("t"), F.col("x.copy").alias("copy"), *fixed, extra.alias("extra"), F.col("x.h").alias("h"))


def _read(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("t"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source, copies.

    Null texts have size 0 and are never taken, like texts without a word; a very long text is one
    unit of its size, and only its size and hash move; a null source is a source of its own, the
    last; rows with equal ids, and equal rows, are documents of their own; null ids stay null. A
    source misses its target by what the exchanges of `_last` leave (24 documents at most change
    their decision for it), which is a few words unless all its other documents are of one size.
    Extra columns are not read. An empty table gives no rows."""
    found = decide(_read(docs, id_col, source_col, text_col), **how)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0))
    found = found.withColumn("copies", copies)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs. Rows without a
    word are not taken. Decisions are made on ids, sizes and hashes; texts are joined once, and only
    rows equal in id, source and text that are taken unlike each other are counted among themselves
    (which of them goes is open)."""
    k1, k2, times, more, turn = free_name(docs, "k1", "k2", "times", "more", "turn")
    found = decide(_read(docs, id_col, source_col, text_col), **how).where("size > 0")
    key = row_key(F.col("doc_id"), F.col("source"), F.col("t"))
    classes = found.groupBy(key[0].alias(k1), key[1].alias(k2)).agg(F.max("whole").alias(times), F.sum("extra").cast("int").alias(more), F.count("*").alias(turn))
    classes = cut(classes.where(F.col(times) + F.col(more) > 0))
    split = (F.col(more) > 0) & (F.col(more) < F.col(turn))
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = row_key(F.col(id_col), F.col(source_col), F.xxhash64(F.col(text_col)))
    keyed = docs.withColumns({k1: key[0], k2: key[1]})
    alike = bounded(classes.where(~split).select(k1, k2, (F.col(times) + (F.col(more) > 0).cast("int")).alias(times)))
    out = keyed.join(alike, [k1, k2]).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
    uneven = classes.where(split).drop(turn)
    if not uneven.isEmpty():
        rows = keyed.join(bounded(uneven), [k1, k2]).withColumn(turn, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1)))
        copies = F.col(times) + F.when(F.col(turn) <= F.col(more), 1).otherwise(0)
        rows = rows.withColumn(turn, copies).where(F.col(turn) > 0)
        out = out.unionByName(rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turn)))).select(*names))
    return out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
