"""Centroid clustering and vector near-duplicates against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from tests.llm.rows import listed
from tests.oracle import connect, duckdb_rows, spark_rows
from tracewright.llm import centroids, pivots

VEC = "vec_id long, embedding array<double>, label int"
CLASHING = "x int, cluster string, uid string, h1 int, near string, n_links string, upper int"


def plain_clusters(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, np.array([math.floor(scale * c) for c in v], object)) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) and abs(c) * scale < 2**27 for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), list(r[1])))
    c = [v for _, v in order[:k]]

    def own(v):
        return min((int(((v - x) ** 2).sum()), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [own(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = np.array([int(s) // len(mine) for s in sum(mine)], object)
    return sorted(((i, own(v)[1], own(v)[0]) for i, v in kept), key=repr)


def awkward(spark, extra=False):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 64))
    rows = [(k, (base[k % 12] + rng.normal(size=64) * 0.02 * (k % 5)).tolist(), k % 3) for k in range(150)]
    rows += [(k + 500, rng.integers(-2, 3, 64).astype(float).tolist(), 1) for k in range(60)]  # many ties
    one = rows[3][1]
    rows += [
        (900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [1.0] * 63, 1), (904, [math.nan, *one[1:]], 1), (905, [math.inf, *one[1:]], 1), (906, [None, *one[1:]], 1), (907, one, None),
        (907, one, None), (3, one, 0), (None, one, 0), (None, rows[4][1], 0), (-8, [2 * x for x in one], 1), (909, [-x for x in one], 1), (910, [1e300] * 64, 1), (911, [1e300] * 63 + [9e299], 1), (912, [1.0] * 63, 1), (913, [1.0] * 62 + [1.01], 1), (914, [3e5] * 64, 1),
    ]
    df = spark.createDataFrame(rows, VEC)
    if extra:
        from pyspark.sql import functions as F

        for field in CLASHING.split(", "):
            name, kind = field.split()
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


@pytest.mark.parametrize("extra", [False, True])
def test_clusters(spark, extra):
    df = awkward(spark, extra)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k in (16, 3) if extra else (16,):
        found, middle = centroids.cluster(df, k=k)
        assert len(middle) == k
        assert listed(found, "vec_id", "cluster", "distance") == plain_clusters(rows, k)
    few = df.where("vec_id between 500 and 504")
    found, middle = centroids.cluster(few)
    assert len(middle) == 5 and listed(found, "vec_id", "cluster", "distance") == plain_clusters([r for r in rows if r[0] is not None and 500 <= r[0] <= 504])
    assert centroids.cluster(df.where("false"))[0].count() == 0


def test_clusters_oracle(spark, sf):
    found = centroids.op11_centroids(spark, sf)
    assert spark_rows(found) == duckdb_rows(connect(sf), centroids.ORACLE)
    first = found.first()
    assert first["cluster_inertia"] <= first["inertia"]


def test_bounds_skip_most_distances():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(16, 64))[rng.integers(0, 16, 3000)] * 40 + rng.normal(size=(3000, 64)) * 4).astype(np.int64)
    c = x[:16].copy()
    own, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 16), np.float32)
    for k in range(6):
        took = centroids.nearest(x, c, centroids.between(c), own, upper, lower)
        all_ = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (own == all_.argmin(axis=1)).all()
        new = np.stack([x[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(16)])
        moved = centroids._up(np.sqrt(centroids.squared(new, c).astype(float)))
        upper, lower, c = centroids._up(upper + moved[own]), np.maximum(centroids._down32(lower - moved), np.float32(0)), new
    assert took < 3000 * 16 / 10


def plain_links(rows, cosine=0.95):
    """(id, n_links, component_id, kept) by all pairs."""
    good = lambda v: v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for size in {len(v) for _, v in rows if good(v)}:
        at = [k for k, (_, v) in enumerate(rows) if good(v) and len(v) == size]
        x = np.array([rows[k][1] for k in at])
        x = x / np.abs(x).max(axis=1)[:, None]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        near[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None], n).min(axis=1, initial=n))
        if (new == label).all():
            break
        label = new
    out = []
    for k in range(n):
        ids = [rows[x][0] for x in np.flatnonzero(label == label[k]) if rows[x][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[k][0], int(near[k].sum()), least, least == rows[k][0]))
    return sorted(out, key=repr)


LINKS = ("vec_id", "n_links", "component_id", "kept")


@pytest.mark.parametrize("extra", [False, True])
def test_near_vectors(spark, extra):
    df = awkward(spark, extra)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    expected = plain_links(rows)
    assert sum(r[1] > 0 for r in expected) > 50
    assert listed(pivots.near_vectors(df), *LINKS) == expected
    assert pivots.near_vectors(df.where("false")).count() == 0
    assert listed(pivots.near_vectors(df.where("vec_id = 900 or vec_id = 902")), *LINKS) == [(900, 0, 900, True), (902, 0, 902, True)]


def test_crowds_are_dealt_in_parts_and_every_link_counted_once(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64))
    rows = [(k, (base[0] + rng.normal(size=64) * 0.15).tolist(), 0) for k in range(150)] + [(1000 + k, (base[k % 40] + rng.normal(size=64) * 0.12).tolist(), 0) for k in range(150)]
    rows += [(3000 + k, rows[k % 30][1], 0) for k in range(60)]
    expected = plain_links([(i, v) for i, v, _ in rows])
    for block in (1024, 25):
        found = listed(pivots.near_vectors(spark.createDataFrame(rows, VEC), nearest=10, block=block), *LINKS)
        links = sum(r[1] for r in expected)
        assert all(f[1] <= e[1] for f, e in zip(found, expected, strict=True))
        assert sum(r[1] for r in found) >= 0.999 * links and [r[2] for r in found] == [r[2] for r in expected]


@pytest.mark.parametrize("cosine", [0.95, 0.97])
def test_recall_of_the_index(spark, cosine):
    """Pairs at exactly the cosine asked for, the hardest ones, among others."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=(1500, 64))
    z -= np.einsum("ij,ij->i", z, x)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = (cosine + 1e-9) * x + math.sqrt(1 - (cosine + 1e-9) ** 2) * z
    far = (cosine - 1e-6) * x + math.sqrt(1 - (cosine - 1e-6) ** 2) * z
    rows = [(k, v.tolist(), 0) for k, v in enumerate([*x, *(y[:1000]), *(far[1000:])])]
    found = pivots.near_vectors(spark.createDataFrame(rows, VEC), cosine=cosine).where("n_links > 0").collect()
    assert {r["component_id"] for r in found} <= set(range(1000)) and len(found) >= 2 * 970


def test_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert listed(pivots.op13_near_vectors(spark, sf), *LINKS) == plain_links(rows)
