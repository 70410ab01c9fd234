"""Vector near-duplicates by a pivot-permutation index, verified.

Every vector is described by its ``nearest`` reference points in order of closeness (Chávez,
Figueroa and Navarro 2008; Amato and Savino 2008): close vectors see the references in nearly the same
order. Inverted lists lead from references to vectors; candidates share at least ``shared`` = 3 of
their lists. Counting shared references list by list would pair up whole lists, so lists are kept for
triples of references: two vectors share three references exactly if they meet in a triple's list.
A pair is counted in one list only, that of its three smallest shared references. Lists with the
same members are one list, so a few close vectors are compared once, not once for each triple.

References are ``28 * n ** (1/3)`` for n distinct vectors, at most 32,768: chance then fills a list
with as many vectors at any n. They come from a bounded sample in order of a hash, none too close to
one before it, so that no crowd of copies takes them all; what lacks is drawn at random. Measured on
random pairs in 64 dimensions: of pairs at cosine exactly 0.95 a thousand references find 0.988, at
0.96 0.995, at 0.98 0.9995; pairs found are verified on the vectors in double precision.

Lists longer than ``block`` are dealt as pairs of parts. Tasks send back a number of links for each
vector and a spanning forest, never all pairs. Equal vectors are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table
from .components import components

MOST_REFERENCES = 32_768
SHARED = 3


def usable(v: Column) -> Column:
    """Whether a vector has a direction: components, all finite, not all zero."""
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component first, so that no square leaves the doubles."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def references(sample: np.ndarray, m: int, closest: float = 0.8) -> np.ndarray:
    """m unit vectors: those of the sample in turn that are not too close to one before, then random
    directions."""
    size = sample.shape[1]
    out = np.zeros((m, size))
    n = 0
    for row in unit(sample) if len(sample) else sample:
        if n == m:
            break
        if not n or (out[:n] @ row).max() <= closest:
            out[n] = row
            n += 1
    if n < m:
        out[n:] = unit(np.random.Generator(np.random.PCG64(13)).standard_normal((m - n, size)))
    return out


def closest_references(x: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """The numbers of each row's k nearest reference points, nearest first."""
    out = np.empty((len(x), k), np.int32)
    step = max(1, 4_000_000 // len(points))
    for at in range(0, len(x), step):
        near = unit(x[at : at + step]) @ points.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        turn = np.lexsort((top, -np.take_along_axis(near, top, axis=1)), axis=1)
        out[at : at + step] = np.take_along_axis(top, turn, axis=1)
    return out


def _described(batches: Iterator, points: np.ndarray, k: int) -> Iterator:
    """Batches (uid, v) to (uid, near)."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            near = closest_references(_matrix(batch.column("v"), points.shape[1]), points, k)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, k, dtype=np.int32), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), lists], ["uid", "near"])


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _firsts(near: np.ndarray, last: np.ndarray) -> np.ndarray:
    """near with the references after a row's ``last`` put out of count. A list is that of a pair's
    three smallest shared references if just three of those not after its own last are shared."""
    return np.where(near <= last[:, None], near, -1)


def _pairs(x: np.ndarray, firsts: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs (rows i and j of one list) are links that this list counts."""
    good = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
    at = np.flatnonzero(good)
    a, b = firsts[i[at]], firsts[j[at]]
    good[at] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).sum(axis=(1, 2)) == SHARED
    return good


def _block(x: np.ndarray, firsts: np.ndarray, side: np.ndarray | None, cosine: float) -> np.ndarray:
    """The links of one list's rows as a matrix; with sides only those from one to the other."""
    known = np.unique(firsts[firsts >= 0])
    holds = np.zeros((len(x), len(known)), np.float32)
    row, col = np.nonzero(firsts >= 0)
    holds[row, np.searchsorted(known, firsts[row, col])] = 1
    links = (x @ x.T >= cosine) & (holds @ holds.T == SHARED)
    np.fill_diagonal(links, False)
    if side is not None:
        links &= side[:, None] != side[None]
    return links


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row of a matrix of links the smallest row that it is joined to."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(batches: Iterator, size: int, cosine: float, few: int = 8) -> Iterator:
    """Batches (key, part, side, uid, n, last, near, v) in order of (key, part) to rows (a, b, n): b
    null: a has links to n further rows; n null: a and b are joined. A part below 0 is compared in
    itself, another one across its two sides."""
    import pyarrow as pa

    names = ["key", "part", "side", "uid", "n", "last"]

    def links(held: list) -> pa.RecordBatch:
        table_ = pa.Table.from_batches(held)
        key, part, side, uid, n, last = (table_[c].to_numpy() for c in names)
        x = unit(_matrix(table_["v"].combine_chunks(), size))
        near = _matrix(table_["near"].combine_chunks(), len(table_["near"][0]))
        firsts = _firsts(near, last)
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        sizes = np.diff(np.append(start, len(key)))
        run = np.repeat(np.arange(len(sizes)), sizes)
        counts, ends = np.zeros(len(key), np.int64), []
        short = sizes <= few
        for step in range(1, few):
            i = np.flatnonzero((run[step:] == run[:-step]) & short[run[step:]])
            j = i + step
            apart = (side[i] != side[j]) | (part[i] < 0)  # of two parts only pairs across
            i, j = i[apart], j[apart]
            good = _pairs(x, firsts, i, j, cosine)
            i, j = i[good], j[good]
            np.add.at(counts, i, n[j])
            np.add.at(counts, j, n[i])
            ends.append(np.stack([uid[i], uid[j]], 1))
        for at, m in zip(start[~short].tolist(), sizes[~short].tolist(), strict=True):
            rows = slice(at, at + m)
            found = _block(x[rows], firsts[rows], None if part[at] < 0 else side[rows], cosine)
            counts[rows] += found @ n[rows]
            label = _forest(found)
            moved = np.flatnonzero(label != np.arange(m))
            ends.append(np.stack([uid[rows][moved], uid[rows][label[moved]]], 1))
        some = np.flatnonzero(counts)
        pairs = np.concatenate(ends) if ends else np.zeros((0, 2), np.int64)
        a, b = np.concatenate([uid[some], pairs[:, 0]]), np.concatenate([np.zeros(len(some), np.int64), pairs[:, 1]])
        is_pair = np.arange(len(a)) >= len(some)
        n_out = np.concatenate([counts[some], np.zeros(len(pairs), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~is_pair), pa.array(n_out, mask=is_pair)], ["a", "b", "n"])

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
        tail = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        split = int(tail[-1]) + 1 if len(tail) else 0
        if held and (held[-1].column("key")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (key[0], part[0]):
            yield links(held)
            held = []
        if split:
            yield links([*held, batch.slice(0, split)])
            held = []
        held.append(batch.slice(split))
    if held:
        yield links(held)


def _links(distinct: DataFrame, size: int, n: int, cosine: float, nearest: int, m: int | None, sample: int, block: int) -> DataFrame:
    """distinct(uid, h1, h2, n, v), all of one size, to rows (a, b, n) as _verified gives them."""
    m = m or min(MOST_REFERENCES, round(28 * n ** (1 / 3)))
    m = max(m, nearest, 16)
    first = distinct.orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(max(sample, 2 * m)).select("v").collect()  # a bounded sample
    points = references(np.array([r["v"] for r in first], np.float64).reshape(-1, size), m)
    near = cut(distinct.select("uid", "v").mapInArrow(lambda b: _described(b, points, nearest), "uid long, near array<int>"))
    order = F.array_sort("near")
    keyed = near.select("uid", order.alias("s")).select("uid", F.explode(F.array(*[F.struct(((F.col("s")[a].cast("long") * m + F.col("s")[b]) * m + F.col("s")[c]).alias("key"), F.col("s")[c].alias("last")) for a, b, c in combinations(range(nearest), SHARED)])).alias("k"))
    keyed = keyed.select("uid", "k.key", "k.last")
    lists = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("uid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("x2")).where("rows > 1")
    lists = cut(lists.groupBy("rows", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("rows") / block).cast("int").alias("parts")))
    home = F.pmod(F.xxhash64("uid", F.lit(2)), F.col("parts")).cast("int")
    part = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, home) * F.col("parts") + F.greatest(j, home))
    dealt = keyed.join(bounded(lists), "key").withColumn("side", home)
    dealt = dealt.select("key", "last", "uid", "side", "parts", F.explode(part).alias("at"))
    inside = F.col("at") == F.col("side") * F.col("parts") + F.col("side")
    dealt = dealt.select("key", F.when(inside, -1 - F.col("at")).otherwise(F.col("at")).cast("int").alias("part"), F.when(inside, 0).otherwise(F.col("side")).cast("int").alias("side"), "uid", "last")
    # descriptions and vectors meet first, so each moves once; then copies go to the lists
    rows = dealt.join(near.join(distinct.select("uid", "n", "v"), "uid"), "uid").select("key", "part", "side", "uid", "n", "last", "near", "v")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lambda b: _verified(b, size, cosine), "a long, b long, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, nearest: int = 8, n_references: int | None = None, sample: int = 4096, block: int = 1024) -> DataFrame:
    """One row per row of df: vec_id, n_links (other rows found with at least that cosine),
    component_id (the smallest id that links reach, the row's own included) and kept (whether that is
    its own id).

    Vectors of one length are compared with each other, lengths in turn. Null and empty vectors, zero
    vectors and those with a null or non-finite component link with nothing. Equal vectors always
    link; rows with equal ids are rows of their own. A null id is kept; it is a component's id only
    where there is no other, and null equals null in kept. An empty table gives no rows. Extra
    columns are not read. ``sample`` bounds the vectors that reference points are taken from; every
    vector is indexed."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).alias("vec_id"), F.when(usable(F.col(vector_col)), v).alias("v"))
    keyed = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(3), F.reverse("v"))).alias("h2"))
    distinct = keyed.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = cut(distinct.withColumn("uid", F.monotonically_increasing_id()))
    found = None
    for r in sorted(distinct.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).where("n > 1").collect()):  # a row for each length
        own = _links(distinct.where(F.size("v") == r["size"]), r["size"], r["n"], cosine, nearest, n_references, sample, block)
        found = own if found is None else found.unionByName(own)
    one = distinct.drop("v")
    if found is None:
        placed = one.select("h1", "h2", F.col("n") - 1, F.col("least_id")).toDF("h1", "h2", "n_links", "component_id")
    else:
        found = cut(found)
        counts = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
        roots = cut(components(found.where("b is not null").select("a", "b"))).toDF("uid", "root")
        least = roots.join(one.select("uid", "least_id"), "uid").groupBy("root").agg(F.min("least_id").alias("component_id"))
        linked = roots.join(bounded(cut(least)), "root").join(counts, "uid", "left").select("uid", "component_id", "links", F.lit(True).alias("linked"))
        placed = one.join(bounded(cut(linked)), "uid", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"))
    joined = keyed.select("vec_id", "h1", "h2").join(placed, ["h1", "h2"], "left")
    own = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
