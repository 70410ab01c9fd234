"""The program's equations: how they are put together."""

from tracewright.operators import program
from tracewright.plans import registry


def test_equations_take_four_joins(spark, sf):
    plan = program.constraints(registry.flow(spark, sf).rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 4
