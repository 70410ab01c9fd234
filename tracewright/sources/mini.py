"""A small flow graph of 11 hyperedges and 15 variables with two tied optima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values: (edge type, sources, destination, destination type, weights); sources' type is the
#: layer before the destination's.
EDGES = [
    ("AND", ["M1", "M1"], "S2", "am", [0.25, 0.5]),
    ("OR", ["S0"], "J1", "job", [0.5]),
    ("OR", ["S0"], "J2", "job", [0.25]),
    ("OR", ["S0"], "J3", "job", [0.75]),
    ("OR", ["S2"], "J4", "job", [0.625]),
    ("OR", ["S2"], "J5", "job", [0.375]),
    ("OR", ["J1", "J2"], "P1F", "cluster_aggr", [0.125, 0.875]),
    ("OR", ["J3"], "P1P", "cluster_aggr", [0.5]),
    ("AND", ["P1F", "P1P"], "M1", "model", [0.75, 0.25]),
    ("OR", ["J4", "J5"], "P2F", "cluster_aggr", [0.5, 0.75]),
    ("AND", ["P2F"], "M2", "model", [0.5]),
]
BEFORE = {"am": "model", "job": "am", "cluster_aggr": "job", "model": "cluster_aggr"}
KIND = {"model": "dsar", "am": "dsar", "job": "dsir", "cluster_aggr": "dsir"}
SCHEMA = "edge_ord long, var_ord long, dst string, dst_kind string, dst_type string, edge_type string, src string, src_kind string, src_type string, pos int, weight double"


def incidences(edges=None) -> list[tuple]:
    out, var = [], 0
    for k, (kind, sources, dst, dst_type, weights) in enumerate(EDGES if edges is None else edges):
        for pos, (src, weight) in enumerate(zip(sources, weights, strict=True)):
            src_type = BEFORE[dst_type]
            out.append((k, var, dst, KIND[dst_type], dst_type, kind, src, KIND[src_type], src_type, pos, weight))
            var += 1
    return out


def rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(incidences(), SCHEMA)
