"""Schemas of provenance documents and of the normalised tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Documents as a provenance store holds them.
DSIR_DOC = _struct(
    _id=_S, created_by=_S, metadata=_struct(model_type=_S, temporal=_struct(begin=_L, end=_L)), parents=T.ArrayType(_S), children=T.ArrayType(_S), dsar=_S
)
DSAR_DOC = _struct(_id=_S, created_by=_S, metadata=_struct(model_type=_S), dsir_list=T.ArrayType(_S))
JOB_DOC = _struct(_id=_S, input_dsars=T.ArrayType(_S), output_dsir=_S, model_type=_S, relevance=_D)

#: Normalised tables; pos keeps the order of an array.
TABLES = {
    "dsir": _struct(dsir_id=_S, created_by=_S, model_type=_S, t_begin=_I, t_end=_I, dsar_id=_S),
    "dsir_parent": _struct(dsir_id=_S, pos=_I, parent_id=_S),
    "dsir_child": _struct(dsir_id=_S, pos=_I, child_id=_S),
    "dsar": _struct(dsar_id=_S, created_by=_S, model_type=_S),
    "dsar_dsir": _struct(dsar_id=_S, pos=_I, dsir_id=_S),
    "job": _struct(job_id=_L, model_type=_S, output_dsir=_S, relevance=_D),
    "job_dsar": _struct(job_id=_L, pos=_I, dsar_id=_S),
}
