"""Tables that are written and read again."""

from pyspark.sql import functions as F

from tracewright.functions.lineage import Scratch, stored


def test_planner_sees_the_size_in_memory(spark):
    """A million short rows are a few MB of file and would be broadcast if that were their size."""
    rows = spark.range(1_000_000).select(F.concat(F.lit("J"), F.col("id").cast("string")).alias("a"), F.lit("S0").alias("b"))
    with Scratch(spark) as keep:
        for table in (stored(rows), keep(rows)):
            plan = table.join(rows, "a")._jdf.queryExecution()
            size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            assert size > 40 * 1_000_000  # two lengths and places and the text of each row
            pruned = table.select("b").groupBy("b").count().join(table, "b")._jdf.queryExecution()
            assert "BroadcastHashJoin" not in plan.sparkPlan().toString() and "BroadcastHashJoin" not in pruned.sparkPlan().toString()
