"""Provenance derived from the orders table: each order is a simulation run.

Model = priority digit m, window = order year w; runs are post-synchronised by status (F and P, not
O), and the results of a window feed the next one's runs of the same model and of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import stored
from .documents import Tables
from .schema import TABLES

ORDERS = "{orders}"

COMMON = """
o AS (SELECT o_orderkey AS k, cast(substr(o_orderpriority,1,1) AS int) AS m, cast(year(o_orderdate) AS int) AS w, o_orderstatus AS c, o_orderpriority AS mt FROM {orders}),
mt AS (SELECT DISTINCT m, mt FROM o),
up AS (SELECT m, m AS u, 0 AS pos FROM mt UNION ALL SELECT m, m % 5 + 1 AS u, 1 AS pos FROM mt),
mw AS (SELECT DISTINCT m, w FROM o),
psm AS (SELECT DISTINCT m, w, c FROM o WHERE c IN ('F','P')),
am AS (SELECT mw.m, mw.w, up.u, up.pos FROM mw JOIN up ON up.m = mw.m JOIN psm ON psm.m = up.u AND psm.w = mw.w - 1 AND psm.c = 'F'),
oj AS (SELECT * FROM o WHERE c = 'O' AND k % 100 = 1)
"""

PARTS = {
    "dsir": """
  SELECT concat('J', cast(k AS string)) AS dsir_id, 'JobGateway' AS created_by, mt AS model_type, w AS t_begin, w + 1 AS t_end, cast(NULL AS string) AS dsar_id FROM o
  UNION ALL SELECT concat('P', cast(p.m AS string), '-', cast(w AS string), '-', c), 'PostSynchronizationManager', mt.mt, w, w + 1, concat('M', cast(p.m AS string), '-', cast(w AS string)) FROM psm p JOIN mt ON mt.m = p.m
  UNION ALL SELECT concat('A', cast(a.m AS string), '-', cast(w AS string), '-', cast(u AS string)), 'AlignmentManager', mt.mt, w, w + 1, concat('S', cast(a.m AS string), '-', cast(w AS string), '-', cast(u AS string)) FROM am a JOIN mt ON mt.m = a.m""",
    "dsir_parent": """
  SELECT concat('J', cast(o.k AS string)) AS dsir_id, am.pos AS pos, concat('A', cast(am.m AS string), '-', cast(am.w AS string), '-', cast(am.u AS string)) AS parent_id FROM o JOIN am ON am.m = o.m AND am.w = o.w
  UNION ALL SELECT concat('P', cast(m AS string), '-', cast(w AS string), '-', c), cast(row_number() OVER (PARTITION BY m, w, c ORDER BY k) - 1 AS int), concat('J', cast(k AS string)) FROM o WHERE c IN ('F','P')
  UNION ALL SELECT concat('A', cast(am.m AS string), '-', cast(am.w AS string), '-', cast(am.u AS string)), CASE WHEN p.c = 'F' THEN 0 ELSE 1 END, concat('P', cast(p.m AS string), '-', cast(p.w AS string), '-', p.c) FROM am JOIN psm p ON p.m = am.u AND p.w = am.w - 1
  UNION ALL SELECT concat('A', cast(am.m AS string), '-', cast(am.w AS string), '-', cast(am.u AS string)), cast(1 + row_number() OVER (PARTITION BY am.m, am.w, am.u ORDER BY oj.k) AS int), concat('J', cast(oj.k AS string)) FROM am JOIN oj ON oj.m = am.u AND oj.w = am.w - 1""",
    "dsir_child": """
  SELECT concat('J', cast(k AS string)) AS dsir_id, 0 AS pos, concat('P', cast(m AS string), '-', cast(w AS string), '-', c) AS child_id FROM o WHERE c IN ('F','P')
  UNION ALL SELECT concat('J', cast(oj.k AS string)), cast(row_number() OVER (PARTITION BY oj.k ORDER BY am.m) - 1 AS int), concat('A', cast(am.m AS string), '-', cast(am.w AS string), '-', cast(am.u AS string)) FROM oj JOIN am ON am.u = oj.m AND am.w = oj.w + 1""",
    "dsar": """
  SELECT DISTINCT concat('M', cast(p.m AS string), '-', cast(w AS string)) AS dsar_id, 'PostSynchronizationManager' AS created_by, mt.mt AS model_type FROM psm p JOIN mt ON mt.m = p.m
  UNION ALL SELECT concat('S', cast(am.m AS string), '-', cast(am.w AS string), '-', cast(u AS string)), 'AlignmentManager', mt.mt FROM am JOIN mt ON mt.m = am.u
  UNION ALL SELECT 'S0', 'AlignmentManager', 'undefined'""",
    "dsar_dsir": """
  SELECT dsar_id, cast(row_number() OVER (PARTITION BY dsar_id ORDER BY dsir_id) - 1 AS int) AS pos, dsir_id FROM dsir WHERE dsar_id IS NOT NULL""",
    "job": """
  SELECT k AS job_id, mt AS model_type, concat('J', cast(k AS string)) AS output_dsir, cast((k * 37) % 1024 AS double) / 1024 AS relevance FROM o""",
    "job_dsar": """
  SELECT o.k AS job_id, am.pos AS pos, concat('S', cast(am.m AS string), '-', cast(am.w AS string), '-', cast(am.u AS string)) AS dsar_id FROM o JOIN am ON am.m = o.m AND am.w = o.w
  UNION ALL SELECT o.k, 0, 'S0' FROM o LEFT ANTI JOIN am ON am.m = o.m AND am.w = o.w""",
}


def duckdb_tables() -> str:
    """The tables as common table expressions for DuckDB over its view orders."""
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in PARTS.items())
    return f"{COMMON},\n{parts}".replace("{orders}", "orders").replace("LEFT ANTI JOIN", "ANTI JOIN")


_KEPT: dict[tuple, Tables] = {}


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """What the tables depend on: the session and the files of orders with their length and time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/orders.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    return spark.sparkContext.applicationId, sf_dir, *files


def build(spark: SparkSession, sf_dir: str) -> Tables:
    """The seven tables over sf_dir/orders.parquet."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made: dict[str, DataFrame] = {}
    for name, sql in PARTS.items():
        with_dsir = {"dsir": made["dsir"]} if name == "dsar_dsir" else {}
        query = f"WITH {COMMON} {sql}".replace("FROM dsir WHERE", "FROM {dsir} WHERE") if with_dsir else f"WITH {COMMON} {sql}"
        made[name] = stored(spark.sql(query, orders=orders, **with_dsir).select(*TABLES[name].names))
    return made


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The seven tables, made once for a session and a state of the files."""
    key = state(spark, sf_dir)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build(spark, sf_dir)
    return _KEPT[key]
