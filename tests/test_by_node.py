"""Incidences stored by node: results and plans."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import program
from tracewright.plans.registry import flow
from tracewright.sources.by_node import ByNode


def bag(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cold_only(stored, of):
    """The plan of what is asked at ordinary nodes."""
    stored.hot, hot = {}, stored.hot
    both, stored._both = stored._both, lambda asked: asked(stored.cold)
    found = plan(of(stored))
    stored.hot, stored._both = hot, both
    return found


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("hot_rows", [1_000_000, 50, 0])
def test_results_are_those_of_plain_incidences(spark, sf, hot_rows):
    rows = flow(spark, sf).rows
    with ByNode(rows, 4, hot_rows) as stored:
        n_hot, n_nodes = stored.hot_nodes.count(), flow(spark, sf).degrees().count()
        assert n_hot == 0 if hot_rows == 1_000_000 else n_hot == n_nodes if hot_rows == 0 else 0 < n_hot < n_nodes
        for mine, plain in ((stored.incoming_sums(), program.incoming_sums(rows)), (stored.outgoing_sums(), program.outgoing_sums(rows)), (stored.constraints(), program.constraints(rows))):
            assert bag(mine, *plain.columns) == bag(plain, *plain.columns)
        some = rows.where("dst_type = 'model'").select(F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type")).distinct()
        step = rows.join(some.toDF("dst", "dst_type"), ["dst", "dst_type"]).select(F.col("src").alias("node_id"), F.col("src_type").alias("node_type")).distinct()
        assert bag(stored.sources_of(some), "node_id", "node_type") == bag(step, "node_id", "node_type")
        path = stored.path.removeprefix("file:")
    import os

    assert not os.path.exists(path) and not [t for t in spark.catalog.listTables() if t.name.startswith("by_node_")]


def test_plans_move_no_incidences(spark, sf, no_broadcast):
    rows = flow(spark, sf).rows
    with ByNode(rows, 4) as stored:
        for of in (lambda s: s.incoming_sums(), lambda s: s.outgoing_sums()):
            assert "Exchange" not in cold_only(stored, of)
        met = cold_only(stored, lambda s: s._both(s._bk).join(s._both(s._fr), "node"))
        assert "SortMergeJoin" in met and "Exchange" not in met
        assert cold_only(stored, lambda s: s.constraints()).count("Exchange") == 1  # the terms, to be added up
        some = spark.createDataFrame([("M3-1998", "model")], "node_id string, node_type string")
        step = cold_only(stored, lambda s: s._both(lambda t: t["dst"].join(some.select(F.concat_ws(":", "node_type", "node_id").alias("node")), "node")))
        assert step.count("Exchange") == 1  # the nodes asked for
        # a look-up reads one bucket's file: with files too dear to share a task, tasks count files
        before = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b"))
        stored._both = lambda asked: asked(stored.cold)
        tasks = [df.rdd.getNumPartitions() for df in (stored.found("S0", "am", "src"), stored.cold["src"])]
        spark.conf.set("spark.sql.files.openCostInBytes", before)
        assert tasks == [1, 4]
