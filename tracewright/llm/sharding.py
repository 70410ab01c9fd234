"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard depends on its id and the number of shards alone, with no table of a ring; with one
more shard, rows move only into the new one. Within a shard, rows are numbered without a gap: a
second hash, of id and text, deals a shard's rows over buckets of about ``bucket_rows``, the
buckets' counts are added up, and rows are numbered inside their bucket, so no task ever sees a
whole shard, nor all rows of one id unless their texts are equal too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, by_batch, cut, free_name, table

SHARDS = 8
BUCKET_ROWS = 20_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    key = keys.astype(np.uint64).copy()
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((at[moving] + 1) * step).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shards_of(shards: int):
    """A vectorised function from a stable key (long) to its shard and its shard with one more."""
    import pyarrow as pa

    def of(keys: pa.Array) -> pa.Array:
        k = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return pa.StructArray.from_arrays([pa.array(jump(k, n).astype(np.int32)) for n in (shards, shards + 1)], ["shard", "grown_shard"])

    of.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return by_batch(of, "shard int, grown_shard int")


def place(docs: DataFrame, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard, slot and grown_shard (as well as size, text_crc32 and law), in place of
    columns of these names.

    Null ids are one key of their own; rows with equal ids share a shard, each with a slot of its
    own, in the order of id, checksum and size inside a bucket (rows equal in all three take theirs
    in any order); null texts have size 1 and the checksum of no bytes; a very long text is a row
    like others. An empty table gives no rows."""
    buckets = max(1, -(-docs.count() // (shards * bucket_rows)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    names = [c for c in docs.columns if c.lower() not in made]
    at, bucket, before = free_name(docs, "at", "bucket", "before")
    rows = docs.withColumn(at, shards_of(shards)(F.xxhash64(F.col(id_col))))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in names], F.octet_length(text).cast("long").__add__(1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col(f"{at}.shard").alias("shard"), F.col(f"{at}.grown_shard").alias("grown_shard"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(1)), F.lit(buckets)).cast("int").alias(bucket),
    )
    counts = rows.groupBy("shard", bucket).agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.select("shard", bucket, F.coalesce(offset, F.lit(0)).alias(before)))
    inside = Window.partitionBy("shard", bucket).orderBy(id_col, "text_crc32", "size")
    rows = rows.withColumn("slot", F.row_number().over(inside) - 1).join(bounded(counts), ["shard", bucket])
    return rows.select(*[F.col(f"`{c}`") for c in names], "size", "text_crc32", "law", "shard", (F.col("slot") + F.col(before)).cast("long").alias("slot"), "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
