"""Column expressions of the provenance domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Who creates records, and how edges and nodes are typed.
JOB_GATEWAY = "JobGateway"
POST_SYNC = "PostSynchronizationManager"
ALIGNMENT = "AlignmentManager"
AND, OR = "AND", "OR"
MODEL, AM, JOB, CLUSTER = "model", "am", "job", "cluster_aggr"
DSAR, DSIR = "dsar", "dsir"
START_FINISH = "start-finish"


def hash_weight(dst_type: Column, dst: Column, src: Column, pos: Column) -> Column:
    """A repeatable weight in [0, 1): four hex digits of an MD5 over 65536, exact in binary."""
    text = F.concat(dst_type, F.lit("|"), dst, F.lit("|"), src, F.lit("|"), pos.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("double") / 65536


def label(node_type: Column, kind: Column, node_id: Column) -> Column:
    """A node's display label: its types and the last three characters of its id. Labels may
    coincide and are never keys."""
    return F.concat_ws("-", node_type, kind, F.substring(node_id, -3, 3))


def connector(connect_to: Column) -> Column:
    return F.struct(connect_to.cast("string").alias("connectTo"), F.lit(START_FINISH).alias("connectorType"))
