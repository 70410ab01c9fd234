"""Every query of the library against its DuckDB equivalent, at the smallest scale."""

import pytest

from tests.oracle import connect, duckdb_rows, spark_rows
from tracewright.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(name, spark, sf, con):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == duckdb_rows(con, registry.ORACLES[name])


def test_every_query_has_an_oracle():
    assert registry.QUERIES.keys() == registry.ORACLES.keys() | registry.NO_ORACLE


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 584
    assert registry.QUERIES.keys() <= __spark_entry__.queries().keys()


def test_optimum_is_feasible(spark, sf):
    from pyspark.sql import functions as F

    from tracewright.operators import program

    rows = registry.flow(spark, sf).rows
    chosen = registry.QUERIES["lp_optimum"](spark, sf).cache()
    sums = program.constraints(rows).join(chosen, "var_ord").groupBy("node_id", "node_type").agg(F.sum("coef").alias("off"))
    assert sums.where("off <> 0").count() == 0
    assert program.sink(rows).join(chosen, "var_ord").count() == 1
    total = program.objective(rows).join(chosen, "var_ord").agg(F.sum("weight")).first()[0]
    assert {r["total"] for r in chosen.select("total").distinct().collect()} == {total}
    first = {r["dst"] for r in rows.where("dst_type = 'model' and pos = 0").join(chosen, "var_ord").collect()}
    assert first and registry.QUERIES["optimal_path"](spark, sf).count() == 2 * len(first)


def test_answers_are_those_of_the_choice(spark, sf):
    """The answers that SQL cannot find, worked out from the choice in plain Python."""
    import json

    from tracewright.plans.registry import MIDDLE, flow, tables

    chosen = {r["var_ord"] for r in registry.QUERIES["lp_optimum"](spark, sf).collect()}
    rows = flow(spark, sf).rows.collect()
    lists = {}
    for r in tables(spark, sf)["dsar_dsir"].collect():
        lists.setdefault(r["dsar_id"], []).append((r["pos"], r["dsir_id"]))
    path = sorted((r["edge_ord"], pos, x) for r in rows if r["dst_type"] == "model" and r["pos"] == 0 and r["var_ord"] in chosen for pos, x in lists[r["dst"]])
    assert path and sorted(tuple(r) for r in registry.QUERIES["optimal_path"](spark, sf).collect()) == path

    label = lambda kind, type_, node: f"{kind}-{type_}-{node[-3:]}"
    drawn = {}
    for r in sorted(rows, key=lambda r: r["var_ord"]):
        a, b = sorted((label(r["src_type"], r["src_kind"], r["src"]), label(r["dst_type"], r["dst_kind"], r["dst"])))
        drawn[a, b] = (f"e{r['var_ord']}", "r" if r["var_ord"] in chosen else "g")
    assert {(r["a"], r["b"]): (r["var_name"], r["colour"]) for r in registry.QUERIES["viz_optimum"](spark, sf).collect()} == drawn

    answers = {}
    for r in registry.QUERIES["service_answers"](spark, sf).collect():
        answers.setdefault(r["call"], []).append(json.loads(r["json"]))
    assert sorted((x["edge_ord"], x["pos"], x["dsir_id"]) for x in answers["optimal_path"]) == path
    assert len(answers["model_graph"]) == 584 and {"node_id": MIDDLE} in answers["timeline"]
