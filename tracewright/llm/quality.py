"""Quality classifier: hashed word n-gram logistic regression by FTRL-proximal updates.

A text is cut into words and runs of punctuation, case kept; unigrams and bigrams are hashed into
2**bits weights (a bigram of one word with itself is one feature of its own, so stuttering shows
whatever the word is). A feature's value is its count over the root of the number of features.
Training is McMahan et al.'s FTRL-proximal (2013) over a bounded labelled sample on the driver; the
weights (2**bits floats, a fixed size) go to the executors with the scoring function, which is a
sparse dot product: the weights at a text's features are added up.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, fold, free_name, table
from .labelled import sample

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")
STUTTER = 1


def features(text: bytes, bits: int) -> np.ndarray:
    """Hashed unigrams and bigrams of a text, repeats included."""
    one = np.fromiter(map(crc32, TOKEN.findall(text)), np.uint64)
    if not len(one):
        return np.zeros(0, np.int64)
    mixed = (one * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    two = ((one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    two[one[:-1] == one[1:]] = STUTTER
    return np.concatenate((mixed, two)).astype(np.int64)


def counted(text: bytes, bits: int) -> bytes:
    """A text's distinct features and then their counts, as int32 numbers."""
    at, count = np.unique(features(text, bits), return_counts=True)
    return np.concatenate((at, count)).astype(np.int32).tobytes()


def fit(rows: list[tuple[bytes, int]], bits: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, one example (counted features, label) at a time in the
    given order. No example gives zero weights."""
    size = (1 << bits) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)
    examples = []
    for packed, y in rows:
        at, count = np.frombuffer(packed, np.int32).reshape(2, -1)
        examples.append((np.append(at, np.int32(size - 1)), count, y))

    def weights(at):
        shrunk = np.where(np.abs(z[at]) <= l1, 0.0, z[at] - np.sign(z[at]) * l1)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for at, count, y in examples:
            x = np.append(count / np.sqrt(max(1, count.sum())), 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 18, max_rows: int = 4000) -> tuple[np.ndarray, float]:
    """The model, from at most max_rows labelled rows that are not held out. The executors hash
    the sampled texts and count their features, so a row sends the driver at most 2**bits pairs of
    int32 (2 MB at 18 bits), however long its text is. Rows are taken in the order of crc32 of the
    id, ties by id; of several texts of one id the least counts."""
    import pyarrow as pa

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([counted(x, bits) for x in bytes_of(texts)], pa.binary())

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    hashed = sample(docs, labels, max_rows, id_col, text_col).select("doc_id", "y", by_batch(of, "binary")("text").alias("x"))
    rows = sorted(hashed.toLocalIterator(), key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit([(r["x"], r["y"]) for r in rows], bits)


def scorer(weights: np.ndarray, bias: float, bits: int):
    """A vectorised function from a text column to scores."""
    import pyarrow as pa

    def of(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for k, text in enumerate(bytes_of(texts)):
            found = features(text, bits)
            out[k] = bias + (weights[found].sum(dtype=np.float64) / np.sqrt(len(found)) if len(found) else 0.0)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return by_batch(of, "double")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 18, max_rows: int = 4000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Texts are scored whole at any length. Null and empty texts score the bias alone; with no labelled row every score is 0.5; rows with
    equal ids each have their own row; a null id counts as the empty id for held_out. Extra
    columns are not read. An empty table gives no rows."""
    weights, bias = train(docs, labels, id_col, text_col, bits, max_rows)
    out = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), 3) == 1).alias("held_out"), scorer(weights, bias, bits)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **model) -> DataFrame:
    """The rows of docs that score at_least, with the columns of docs."""
    (name,) = free_name(docs, "score")
    bits = model.get("bits", 18)
    weights, bias = train(docs, labels, id_col, text_col, bits, model.get("max_rows", 4000))
    return docs.withColumn(name, scorer(weights, bias, bits)(F.col(text_col))).where(F.col(name) >= at_least).drop(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
