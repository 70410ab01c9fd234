"""Connected components against plain union."""

import random

from tracewright.operators.components import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def found(spark, nodes, links, **options):
    n = spark.createDataFrame([(k,) for k in nodes], "node long")
    rows = components(n, spark.createDataFrame(links, "a long, b long"), **options).collect()
    assert len(rows) == len(nodes)
    return {r["node"]: r["root"] for r in rows}


def test_long_way_is_the_work_of_one_round(spark):
    way = [(k, k + 1) for k in range(299)]
    assert set(found(spark, range(300), way, max_rounds=1).values()) == {0}


def test_components_against_union(spark):
    chance = random.Random(3)
    for n in (0, 25, 60):
        links = [(chance.randrange(60), chance.randrange(60)) for _ in range(n)]
        assert found(spark, range(60), links) == roots(range(60), links)
    hub = [(59, k) for k in range(0, 59, 2)]  # ends that only their common neighbour links
    assert found(spark, range(60), hub) == roots(range(60), hub)
