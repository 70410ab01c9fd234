"""Centroid clustering in exact whole numbers, with Elkan's bounds.

Every vector carries, from round to round, an upper bound of the distance to its centroid and a lower
bound of that to each of the k centroids (Elkan 2003). A centroid is passed over if its lower bound,
or half its distance from the vector's own centroid, is greater than the upper bound. Bounds are
rounded outwards and comparisons are strict, so a centroid that ties is never passed over; whatever
is not passed over is decided by the exact squared distance, of equals for the smaller number.

Vectors and bounds are one table in the shared folder, rewritten each round (the one before is
deleted), so a lost executor costs no earlier round. Centroids are k times the vector's size numbers;
they go with the tasks, and each task sends back one sum for each of those numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, fresh_dir, table

#: Components of at most this size keep every squared distance inside a long, for up to 64 of them.
LARGEST = 1 << 27


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors with exactly that many components, all finite, as floor(scale * x)."""
    v = F.col(vector_col)
    fit = (F.size(v) == size) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < LARGEST))
    return df.where(v.isNotNull() & fit).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _down32(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down."""
    apart = centroids[:, None] - centroids[None]
    return _down(np.sqrt((apart * apart).sum(axis=2).astype(np.float64))) / 2


def nearest(x: np.ndarray, centroids: np.ndarray, half: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves each row of x to its nearest centroid, of equals the smallest; own, upper and lower are
    changed in place. Returns how many distances it took."""
    n, took = len(x), 0
    best, exact = np.zeros(n, np.int64), np.zeros(n, bool)

    def open_(rows: np.ndarray, j: int) -> np.ndarray:
        a = own[rows]
        return rows[(a != j) & ~(lower[rows, j] > upper[rows]) & ~(half[a, j] > upper[rows])]

    for j in range(len(centroids)):
        rows = open_(np.arange(n), j)
        loose = rows[~exact[rows]]
        if len(loose):
            a = own[loose]
            best[loose], exact[loose] = squared(x[loose], centroids[a]), True
            far = np.sqrt(best[loose].astype(np.float64))
            upper[loose], lower[loose, a] = _up(far), _down32(_down(far))
            took += len(loose)
            rows = open_(rows, j)
        if not len(rows):
            continue
        there = squared(x[rows], centroids[j])
        took += len(rows)
        far = np.sqrt(there.astype(np.float64))
        lower[rows, j] = _down32(_down(far))
        moves = (there < best[rows]) | ((there == best[rows]) & (j < own[rows]))
        at = rows[moves]
        own[at], best[at], upper[at] = j, there[moves], _up(far[moves])
    return took


STATE = "vec_id {id}, x array<int>, cluster int, upper double, lower array<float>"


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _assigned(batches: Iterator, centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> Iterator:
    """Batches (vec_id, x) or states, to states; the last round's to (vec_id, cluster, distance)."""
    import pyarrow as pa

    k, half = len(centroids), between(centroids)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = _matrix(batch.column("x"), centroids.shape[1]).astype(np.int64)
        if moved is None:
            own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k), np.float32)
        else:
            own = batch.column("cluster").to_numpy().astype(np.int64)
            upper = _up(batch.column("upper").to_numpy() + moved[own])
            lower = np.maximum(_down32(_down(_matrix(batch.column("lower"), k).astype(np.float64) - moved)), np.float32(0))
        nearest(x, centroids, half, own, upper, lower)
        out = [batch.column("vec_id"), pa.array(own.astype(np.int32))]
        if last:
            yield pa.RecordBatch.from_arrays([*out, pa.array(squared(x, centroids[own]))], ["vec_id", "cluster", "distance"])
        else:
            bounds = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([out[0], batch.column("x"), out[1], pa.array(upper), bounds], ["vec_id", "x", "cluster", "upper", "lower"])


def _sums(batches: Iterator, k: int, size: int) -> Iterator:
    """Batches (cluster, x) to one row for each cluster and component: how many and their sum."""
    import pyarrow as pa

    counts, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for batch in batches:
        x, own = _matrix(batch.column("x"), size).astype(np.int64), batch.column("cluster").to_numpy()
        counts += np.bincount(own, minlength=k)
        for j in np.unique(own).tolist():
            total[j] += x[own == j].sum(axis=0)
    j, at = np.divmod(np.arange(k * size), size)
    full = counts[j] > 0
    yield pa.RecordBatch.from_arrays([pa.array(c[full]) for c in (j, at, counts[j], total.ravel())], ["cluster", "at", "n", "total"])


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors with exactly ``size`` components, none null or non-finite, each the whole number
    floor(scale * component). Those with a component of 2**27 or more are left out too: their squared
    distances need not fit a long. The first centroids are the k vectors with the smallest SHA-256 of
    ``seed:id`` (a null id is empty text; equal ids by their components); fewer vectors are as many
    centroids. Each round moves vectors to their nearest centroid (ties: the smaller number) and
    centroids to the floor of their vectors' mean; empty ones stay. Then vectors are moved once more.
    Rows with equal ids or vectors each have their own row. An empty table gives no rows and no
    centroid. Extra columns are not read."""
    spark = df.sparkSession
    rows = whole_vectors(df, id_col, vector_col, size, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(order.alias("o"), "x").orderBy("o", "x").limit(k).collect()  # k rows
    centroids, moved = np.array([r["x"] for r in first], np.int64).reshape(-1, size), None
    final = f"vec_id {kind}, cluster int, distance long"
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    before = None
    for _ in range(rounds):
        path = fresh_dir(spark, "clusters")
        rows.mapInArrow(lambda b, c=centroids, m=moved: _assigned(b, c, m, False), STATE.format(id=kind)).write.parquet(path)
        if before:
            delete(spark, before)
        rows, before = spark.read.parquet(path), path
        parts = rows.select("cluster", "x").mapInArrow(lambda b, n=len(centroids): _sums(b, n, size), "cluster long, at long, n long, total long")
        whole = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
        new = centroids.copy()
        for r in parts.groupBy("cluster", "at").agg(whole("n"), whole("total")).collect():  # k * size rows
            new[r["cluster"], r["at"]] = int(r["total"]) // int(r["n"])
        moved = _up(np.sqrt(squared(new, centroids).astype(np.float64)))
        centroids = new
    out = cut(rows.mapInArrow(lambda b, c=centroids, m=moved: _assigned(b, c, m, True), final))
    if before:
        delete(spark, before)
    return out, centroids.tolist()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = sum(int(r["s"]) for r in sums)
    rows = [(r["cluster"], int(r["s"]), total, ",".join(map(str, centroids[r["cluster"]]))) for r in sums]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, numbers string")
    joined = found.join(F.broadcast(of), "cluster")  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("numbers").cast("binary"), 256).alias("centroid_sha256"))


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """The rounds as SQL over all pairs of vector and centroid."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256(concat('1:', vec_id)) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        pairs = f"SELECT id, x, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}"
        parts.append(f"a{r} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(j, d::HUGEINT * {k} + j) AS j, min(d) AS d FROM ({pairs}) GROUP BY id)")
        if r < rounds:
            sums = f"SELECT j, pos, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{r}) GROUP BY j, pos"
            means = f"SELECT j, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY pos) AS c FROM ({sums}) GROUP BY j"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN ({means}) m USING (j))")
    return f"WITH {', '.join(parts)} SELECT vec_id, a.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (j) JOIN v USING (id)"


ORACLE = _oracle()
