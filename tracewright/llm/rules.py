"""Quality rules: gradient-boosted trees over document statistics.

The statistics of a text are exact counts over the whole text. Trees are fitted with numpy to a
bounded labelled sample (second-order logistic boosting over binned statistics); the shares of
symbols, repeated lines and repeated words can only lower a verdict (monotonic constraints: a
split that would raise it is refused, and children are bounded by the middle of their parents'
values). All trees are flattened into five numpy node arrays, and scoring walks every row of a
batch down all of them at once. A fixed base rule rejects first.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, free_name, table
from .labelled import sample

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique", "n_upper", "n_digits", "n_marks", "n_shouts", "n_stops")
SPACES = bytes([0x20, *range(0x09, 0x0E)])
REST = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeated(parts: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of consecutive words that the text has at least twice."""
    import xxhash

    n = len(parts) - window + 1
    if n < 2:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[window - 1 :].tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(joined.__getitem__, map(slice, starts, ends)), repeat(0)), np.uint64, n)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(parts) + 1, np.int64)
    at = np.flatnonzero(np.isin(hashes, np.unique(twice)))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The counts named in COUNTS, of a text in UTF-8."""
    parts = text.split()
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    return (
        len(parts),
        len(text.translate(None, SPACES + REST)),
        _count(text, b"#*$%&|<>"),
        len(full) - len(set(full)),
        repeated(parts),
        len(full),
        len(set(parts)),
        _count(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _count(text, b"0123456789"),
        _count(text, b",;:\"'()-"),
        _count(text, b"!?"),
        _count(text, b"."),
    )


def ratios(counts: np.ndarray) -> np.ndarray:
    """The trees' inputs, a row per row of counts (columns as in COUNTS)."""
    c = dict(zip(COUNTS, counts.astype(np.float64).reshape(-1, len(COUNTS)).T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_unique"] / words, c["n_upper"] / chars,
            c["n_digits"] / chars, c["n_marks"] / words, c["n_shouts"] / words, c["n_stops"] / words, c["n_words"] / lines,
        ],
        1,
    )


#: The first three inputs can only lower the verdict.
MONOTONE = (-1, -1, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0)


class Trees:
    """Node arrays of all trees: feature, threshold, left, right, value; leaves lead to themselves."""

    def __init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.base, self.depth = 0.0, 0

    def node(self) -> int:
        at = len(self.feature)
        for x, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, at), (self.right, at), (self.value, 0.0)):
            x.append(v)
        return at

    def pack(self) -> Trees:
        for name, kind in (("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("right", np.int32), ("value", np.float64), ("roots", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def margin(self, inputs: np.ndarray) -> np.ndarray:
        total = np.full(len(inputs), self.base)
        if not len(inputs) or not len(self.roots):
            return total
        at = np.broadcast_to(self.roots, (len(inputs), len(self.roots))).copy()
        rows = np.arange(len(inputs))[:, None]
        for _ in range(self.depth):
            at = np.where(inputs[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return total + self.value[at].sum(axis=1)

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(inputs), -35, 35)))


def boost(inputs: np.ndarray, y: np.ndarray, monotone=MONOTONE, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 8) -> Trees:
    """Trees for the probability that y is 1. No rows, or rows of one kind, give no trees (a score
    of 0.5, or the rows' own kind)."""
    trees = Trees()
    trees.depth = depth
    if not len(y):
        return trees.pack()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return trees.pack()
    cuts = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) for x in inputs.T]
    binned = np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, inputs.T, strict=True)], 1)
    margin = np.full(len(y), trees.base)

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> None:
        def best_value(gs, hs):
            return np.clip(-gs / (hs + l2), low, high)

        def loss(gs, hs, v):
            return gs * v + 0.5 * (hs + l2) * v * v

        whole = best_value(g[rows].sum(), h[rows].sum())
        trees.value[at] = float(rate * whole)
        if level == depth or len(rows) < 2 * min_rows:
            return
        here, best = loss(g[rows].sum(), h[rows].sum(), whole), (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            n, gs, hs = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (None, g[rows], h[rows]))
            gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
            lv, rv = best_value(gs, hs), best_value(gr, hr)
            gain = here - loss(gs, hs, lv) - loss(gr, hr, rv)
            gain[(n < min_rows) | (len(rows) - n < min_rows)] = -1
            if monotone[f]:
                gain[(rv - lv) * monotone[f] < 0] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k, float(lv[k]), float(rv[k])))
        if best[1] is None:
            return
        f, k, lv, rv = best[1]
        left, right = trees.node(), trees.node()
        trees.feature[at], trees.threshold[at], trees.left[at], trees.right[at] = f, float(cuts[f][k]), left, right
        middle = (lv + rv) / 2
        l_low, l_high, r_low, r_high = low, high, low, high
        if monotone[f] < 0:
            l_low, r_high = middle, middle
        elif monotone[f] > 0:
            l_high, r_low = middle, middle
        goes = binned[rows, f] <= k
        grow(left, rows[goes], g, h, level + 1, l_low, l_high)
        grow(right, rows[~goes], g, h, level + 1, r_low, r_high)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        root = trees.node()
        trees.roots.append(root)
        grow(root, np.arange(len(y)), p - y, p * (1 - p), 0, -8.0, 8.0)
        at = np.full(len(y), root)
        feature, threshold, left, right = (np.array(x) for x in (trees.feature, trees.threshold, trees.left, trees.right))
        for _ in range(depth):
            at = np.where(inputs[np.arange(len(y)), feature[at]] <= threshold[at], left[at], right[at])
        margin += np.array(trees.value)[at]
    return trees.pack()


def _counted():
    import pyarrow as pa

    def of(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(x) for x in bytes_of(texts)], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(COUNTS))

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return by_batch(of, ", ".join(f"{c} long" for c in COUNTS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> Trees:
    """Trees from at most max_rows labelled rows that are not held out."""
    counted = sample(docs, labels, max_rows, id_col, text_col).select("doc_id", "y", _counted()("text").alias("s")).select("doc_id", "y", "s.*")
    rows = counted.toPandas().sort_values("doc_id", kind="stable")
    return boost(ratios(rows[list(COUNTS)].to_numpy()), rows["y"].to_numpy().astype(float))


def judged(trees: Trees, at_least: float):
    """A vectorised function from a text column to base counts, base_failed, score and kept."""
    import pyarrow as pa

    def of(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(x) for x in bytes_of(texts)], np.int64).reshape(-1, len(COUNTS))
        failed = (rows[:, 0] < 10) | (100 * rows[:, 4] > 20 * rows[:, 0])
        scores = trees.score(ratios(rows))
        columns = [*(pa.array(c) for c in rows.T[:5]), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= at_least))]
        return pa.StructArray.from_arrays(columns, [*COUNTS[:5], "base_failed", "score", "kept"])

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return by_batch(of, ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, score double, kept boolean")


def judge(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, score.

    A null or empty text has no words and fails the base rule; rows with equal ids each have their
    own row; null ids stay null; with no labels the base rule decides alone. Texts are counted whole
    at any length, one at a time. Of several texts of one sampled id the least trains the trees, and
    of equal gains the first feature's lowest cut is taken. Extra columns are not read. An empty
    table gives no rows."""
    rule = judged(train(docs, labels, id_col, text_col, max_rows), at_least)
    out = docs.select(F.col(id_col).alias("doc_id"), rule(F.col(text_col)).alias("s"))
    return out.select("doc_id", *[f"s.{c}" for c in (*COUNTS[:5], "base_failed", "kept", "score")])


def keep(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    (name,) = free_name(docs, "verdict")
    rule = judged(train(docs, labels, id_col, text_col, max_rows), at_least)
    return docs.withColumn(name, rule(F.col(text_col))).where(F.col(f"{name}.kept")).drop(name)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
