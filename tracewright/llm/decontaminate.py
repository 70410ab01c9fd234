"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame only.

A test item is found in a document if at least ``threshold`` of its distinct shingles (five words,
lower case; an item of fewer words is one shingle) are in the document. A MinHash of a whole long
document says nothing about a short item (30 shingles in 20,000 have a similarity near 0.001), so
the item is sketched and the document is probed: items are partitioned by size, and an item of a
partition with at most m shingles keeps its floor((1 - threshold) * m) + 1 least hashes. A document
that contains enough of the item lacks at most floor((1 - threshold) * m) shingles and so holds at
least one hash of the sketch: candidates are complete, whatever the document's length. Candidates
are verified by exact shingle containment, on the words themselves.

Documents are read in place; only candidates move. Items, and lists of candidates, are broadcast if
they measure at most ``broadcast_bytes``, and joined by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, bounded, cut, free_name, row_key, table, words

THRESHOLD = 0.8
SHINGLE = 5


def _hash(width: int):
    """A window of `width` words at position i of the words w, hashed without building a string."""
    return F.xxhash64(F.lit(width), *[F.expr(f"w[i + {k}]") for k in range(width)])


def _text(width: int):
    return F.concat_ws(" ", *[F.expr(f"w[i + {k}]") for k in range(width)])


def _windows(rows: DataFrame, width: int, *carry: str) -> DataFrame:
    """One row per window of `width` words: the carried columns, the window's width, hash and text.
    The words never leave the generated code: a column that is not used costs nothing."""
    long = rows.where(F.size("w") >= width).select(*carry, "w", F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("i"))
    return long.select(*carry, F.lit(width).alias("width"), _hash(width).alias("h"), _text(width).alias("shingle"))


def item_shingles(items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, width, h, shingle, n, need, probe): the distinct shingles of every item, how many
    it has, how many a document must hold, and whether the shingle is in the item's sketch. Items
    with a null id or without a word have no rows; rows with one id are one item of all their shingles."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words(F.lower(F.col(text_col))).alias("w"))
    made = None
    for width in range(1, shingle + 1):
        fit = rows.where(F.size("w") == width if width < shingle else F.size("w") >= width)
        found = _windows(fit, width, "item_id").distinct()
        made = found if made is None else made.unionByName(found)
    whole = Window.partitionBy("item_id")
    made = made.withColumn("n", F.count("*").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy("h", "shingle")))
    most = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1  # of the size partition
    sketch = F.floor(most * (1 - threshold) + 1e-9) + 1
    need = F.greatest(F.ceil(F.col("n") * threshold - 1e-9), F.lit(1)).cast("long")
    return made.select("item_id", "width", "h", "shingle", "n", need.alias("need"), (F.col("rank") <= sketch).alias("probe"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(k1, k2, doc_id, item_id, n_shingles, n_found) of every row of docs, by row key, that holds
    an item."""
    parts = cut(item_shingles(items, threshold, shingle, item_id_col, item_text_col))
    widths = sorted(r["width"] for r in parts.select("width").distinct().collect())  # `shingle` at most
    held = bounded(parts, broadcast_bytes)
    key = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(key[0].alias("k1"), key[1].alias("k2"), F.col(id_col).alias("doc_id"), words(F.lower(F.col(text_col))).alias("w"))
    if not widths:
        return rows.where("false").select("k1", "k2", "doc_id", F.lit(0).alias("item_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found"))
    rows = rows.withColumn("room", F.size("w"))
    found = None
    for width in widths:
        sketch = held.where(F.col("probe") & (F.col("width") == width)).select("h", "item_id", "need")
        hit = _windows(rows, width, "k1", "k2", "room").select("k1", "k2", "room", "h").join(sketch, "h")
        hit = hit.where(F.col("room") - width + 1 >= F.col("need")).select("k1", "k2", "item_id").distinct()
        found = hit if found is None else found.unionByName(hit)
    candidates = cut(found)
    wanted = cut(candidates.groupBy("k1", "k2").agg(F.collect_set("item_id").alias("items")))
    near = rows.join(bounded(wanted, broadcast_bytes), ["k1", "k2"])
    exact = None
    for width in widths:
        own = held.where(F.col("width") == width).select("h", F.col("shingle").alias("its"), "item_id", "n", "need")
        hit = _windows(near, width, "k1", "k2", "doc_id", "items").join(own, "h")
        hit = hit.where((F.col("shingle") == F.col("its")) & F.array_contains("items", F.col("item_id"))).select("k1", "k2", "doc_id", "item_id", "n", "need", "h", "its").distinct()
        exact = hit if exact is None else exact.unionByName(hit)
    counted = exact.groupBy("k1", "k2", "doc_id", "item_id").agg(F.max("n").alias("n_shingles"), F.max("need").alias("need"), F.count("*").alias("n_found"))
    return counted.where("n_found >= need").drop("need")


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, n_shingles (of the
    item), n_found (of them in the document), containment.

    Null texts, and items without a word, hold and are nothing; of rows with equal ids the one that
    holds most of the item counts, and ties are one row; a null doc_id is reported as null. Texts are
    read whole at any length. Extra columns are not read. Empty tables give no rows."""
    found = contained(docs, items, **how).groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **how) -> DataFrame:
    """The rows of docs that hold no test item, with the columns of docs. Null and empty texts stay;
    rows equal in id and text go or stay together, and null ids are judged by their texts."""
    bad = cut(contained(docs, items, id_col=id_col, text_col=text_col, broadcast_bytes=broadcast_bytes, **how).select("k1", "k2").distinct())
    k1, k2 = free_name(docs, "k1", "k2")
    key = row_key(F.col(id_col), F.col(text_col))
    bad = bounded(bad.toDF(k1, k2), broadcast_bytes)
    return docs.withColumns({k1: key[0], k2: key[1]}).join(bad, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
ip AS (SELECT DISTINCT item_id, least(len(w), {SHINGLE}) AS width, array_to_string(w[i:i + least(len(w), {SHINGLE}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {SHINGLE}) + 2)) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM ip GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM ip),
dp AS (SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM dw, widths WHERE len(w) >= width)),
hit AS (SELECT doc_id, item_id, count(*) AS n_found FROM dp JOIN ip USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment
FROM hit JOIN n USING (item_id) WHERE n_found >= greatest(ceil(n_shingles * {THRESHOLD} - 1e-9), 1)
"""
