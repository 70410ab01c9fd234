"""What the operators of this subpackage share: tables, words, row keys and cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir

__all__ = ["cut", "shared_dir"]

#: A word: code points that are no ASCII white space. No other white space divides words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system and all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner find and delete the shuffle files of plans that nothing refers to any
    more (it goes by the JVM's garbage collection, which may be long in coming)."""
    import gc
    import time

    for _ in range(2):  # what the first round frees may be the last to refer to a shuffle
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


BROADCAST_BYTES = 32_000_000


def bounded(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcasting if its rows, counted as JSON, are at most so many bytes; larger
    tables are joined by shuffle. df should be cut, for it is read to be measured."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not have, so that extra columns of the input never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def n_pieces(text: Column, between: str) -> Column:
    """How many pieces a regular expression leaves of a text, not counting empty ones at its ends
    (null: 0). Splitting costs a tenth of matching the pieces."""
    parts = F.split(F.coalesce(text, F.lit("")), between, -1)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def n_words(text: Column) -> Column:
    """The number of words (null: 0)."""
    return n_pieces(text, SPACE)


def bytes_of(column, rows: int = 128) -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow string column, b'' for null, a few rows at a time."""
    import pyarrow as pa

    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for at in range(0, len(column), rows):
        for x in column.slice(at, rows).to_pylist():
            yield x or b""


BATCH_ROWS = 1000


def by_batch(of, made: str):
    """of, a function of Arrow arrays, as a vectorised function of columns that gives `made`. Rows
    are whole texts, so the session's Arrow batches are set to BATCH_ROWS rows at most: a batch is
    held several times over on its way to Python and back."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return F.arrow_udf(of, made)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod parts; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def row_key(*columns: Column) -> list[Column]:
    """Two hashes that stand for a row's values in joins (64 and 32 bits); never null."""
    texts = [F.coalesce(c.cast("string"), F.lit("\0null")) for c in columns]
    return [F.xxhash64(*texts), F.crc32(F.concat_ws("\x01", *texts).cast("binary"))]
