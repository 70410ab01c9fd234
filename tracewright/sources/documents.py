"""Provenance documents to normalised tables, and back; checks of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.ranks import ordinals
from .schema import DSAR_DOC, DSIR_DOC, JOB_DOC, TABLES

Tables = dict[str, DataFrame]


def read_documents(spark: SparkSession, folder: str, fmt: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dsir, dsar, jobs) documents of a folder, with declared schemas: dsir, dsar and jobs as JSON
    lines or Parquet."""
    return tuple(spark.read.schema(schema).format(fmt).load(f"{folder}/{name}") for name, schema in (("dsir", DSIR_DOC), ("dsar", DSAR_DOC), ("jobs", JOB_DOC)))


def normalise(dsir: DataFrame, dsar: DataFrame, jobs: DataFrame) -> Tables:
    """Documents to the seven tables. An absent array and an empty one are the same: no rows."""
    unnest = lambda df, key, array, name: df.select(key, F.posexplode(array).alias("pos", name))
    records = dsir.select(
        F.col("_id").alias("dsir_id"), "created_by", F.col("metadata.model_type").alias("model_type"), F.col("metadata.temporal.begin").cast("int").alias("t_begin"),
        F.col("metadata.temporal.end").cast("int").alias("t_end"), F.col("dsar").alias("dsar_id"), "parents", "children",
    )
    lists = dsar.select(F.col("_id").alias("dsar_id"), "created_by", F.col("metadata.model_type").alias("model_type"), "dsir_list")
    runs = ordinals(jobs, ["_id"], "job_id")
    return {
        "dsir": records.drop("parents", "children"),
        "dsir_parent": unnest(records, "dsir_id", "parents", "parent_id"),
        "dsir_child": unnest(records, "dsir_id", "children", "child_id"),
        "dsar": lists.drop("dsir_list"),
        "dsar_dsir": unnest(lists, "dsar_id", "dsir_list", "dsir_id"),
        "job": runs.select("job_id", "model_type", "output_dsir", F.col("relevance").cast("double").alias("relevance")),
        "job_dsar": unnest(runs, "job_id", "input_dsars", "dsar_id"),
    }


def write_tables(tables: Tables, folder: str) -> None:
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> Tables:
    return {name: written(spark, schema, f"{folder}/{name}") for name, schema in TABLES.items()}


#: (table, column, referenced table, referenced column)
REFERENCES = [
    ("dsir_parent", "parent_id", "dsir", "dsir_id"),
    ("dsir_child", "child_id", "dsir", "dsir_id"),
    ("dsir", "dsar_id", "dsar", "dsar_id"),
    ("dsar_dsir", "dsir_id", "dsir", "dsir_id"),
    ("job", "output_dsir", "dsir", "dsir_id"),
    ("job_dsar", "dsar_id", "dsar", "dsar_id"),
]


def validate(tables: Tables) -> DataFrame:
    """Dangling references: (table_name, column_name, missing_id, n)."""
    found = None
    for table, column, other, key in REFERENCES:
        rows = tables[table].where(F.col(column).isNotNull()).select(F.col(column).alias("missing_id"))
        rows = rows.groupBy("missing_id").agg(F.count("*").alias("n")).join(tables[other].select(F.col(key).alias("missing_id")), "missing_id", "left_anti")
        rows = rows.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "missing_id", "n")
        found = rows if found is None else found.unionByName(rows)
    return found
