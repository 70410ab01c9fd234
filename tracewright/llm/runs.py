"""Periodic runs of words: maximal stretches that repeat with a period, found in time that hardly
grows faster than the text.

A run is a stretch of consecutive words with smallest period q that is at least ``shortest`` words
and two periods long and that no neighbouring word extends with that period. Texts are taken many at
a time as one string in which no two share a symbol, so no match crosses from one to the next:

1. Prefix doubling sorts the suffixes; each doubling touches only suffixes that are not yet alone.
   The ranks of all doublings stay, and give the longest common extension of any two places, ahead
   or back, by binary descent.
2. Neighbours in the suffix array give the LCP array; one pass over both with a stack gives the
   longest previous factor (LPF) of every place and where it was (Crochemore and Ilie 2008).
3. LPF cuts a text into LZ blocks. A run that touches the border of a block shows as two extensions
   around the border at its period (Main 1989); only periods up to the lengths of the two blocks at
   the border can be new there, which is three tests for each word.
4. A run strictly inside a block lies in the block's earlier copy too. Runs are held in buckets by
   start, and a block takes those of its copy, in order of start (Kolpakov and Kucherov 1999).

A run needs some stretch of ``shortest / 2`` words twice in its text; texts without (told by sorted
hashes, which never miss an equal stretch) have no run and skip all this.

A text is one row of one task, whatever its length: it takes about 10 bytes for each word and
doubling (20 doublings for a million words that repeat as a whole, fewer if stretches do).
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, table

CHUNK_WORDS = 1 << 16
RUNS = "array<struct<start:long,length:long,period:long>>"


def has_repeat(words: list[bytes], width: int) -> bool:
    """Whether some stretch of that many words may stand twice (never False if one does)."""
    n = len(words) - width + 1
    if n < 2:
        return False
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def symbols(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts in turn as numbers; equal words of one text are equal numbers, and
    texts have no number in common."""
    out, base = [], 0
    for words in texts:
        ids: dict[bytes, int] = {}
        for w in words:
            ids.setdefault(w, base + len(ids))
        out.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        base += len(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Suffixes:
    """The suffix array of a string of numbers, with the ranks of every doubling."""

    def __init__(self, s: np.ndarray) -> None:
        n = self.n = len(s)
        order = np.argsort(s, kind="stable")
        head = np.concatenate(([True], s[order][1:] != s[order][:-1])) if n else np.zeros(0, bool)
        rank = np.zeros(n + 1, np.int64)
        rank[n] = -1
        slots = np.arange(n)
        rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
        self.levels = [rank[:n].astype(np.int32)]
        width = 1
        while n:
            sizes = np.bincount(rank[order], minlength=n)
            open_ = np.flatnonzero(sizes[rank[order]] > 1)  # places in the array that are not settled
            if not len(open_):
                break
            at = order[open_]
            key = rank[at] * (n + 1) + rank[np.minimum(at + width, n)] + 1
            turn = np.argsort(key, kind="stable")
            key, at = key[turn], at[turn]
            order[open_] = at
            first = np.concatenate(([True], key[1:] != key[:-1]))
            rank[at] = np.maximum.accumulate(np.where(first, open_, 0))
            self.levels.append(rank[:n].astype(np.int32))
            width *= 2
        self.order = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on."""
        far, length = np.maximum(i, j), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = np.flatnonzero(far + length + (1 << k) <= self.n)
            same = fits[level[i[fits] + length[fits]] == level[j[fits] + length[fits]]]
            length[same] += 1 << k
        return length

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j."""
        near, length = np.minimum(i, j), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            fits = np.flatnonzero(near - length >= step)
            same = fits[level[i[fits] - length[fits] - step] == level[j[fits] - length[fits] - step]]
            length[same] += step
        return length


def previous_factors(suffixes: Suffixes) -> tuple[list[int], list[int]]:
    """LPF of every place: (length of the longest stretch from there on that also starts earlier, a
    place where it starts)."""
    n, order = suffixes.n, suffixes.order
    lcp = suffixes.ahead(order[:-1], order[1:]).tolist() if n else []
    length, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # (place, common length with the one below), places growing
    for place, common in zip([*order.tolist(), -1], [0, *lcp, 0], strict=True):
        while stack and place < stack[-1][0]:
            top, below = stack.pop()
            if below >= common:  # the last smaller place in the array, or the next one
                length[top], source[top] = below, stack[-1][0] if below else -1
            else:
                length[top], source[top] = common, place
            common = min(common, below)
        stack.append((place, common))
    return length, source


def _borders(s: np.ndarray, suffixes: Suffixes, at: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray, shortest: int) -> np.ndarray:
    """(start, end, period) of the runs that touch a border between blocks. at: the borders; before
    and after: the lengths of the blocks there; low and high: the bounds of the border's text."""
    found = []
    for left in (True, False):
        most = np.minimum(before + after, at - low) if left else np.minimum(after, high - at)
        b = np.repeat(at, most)
        p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
        top, bottom = np.repeat(high, most), np.repeat(low, most)
        i, j = (b - p, b) if left else (b, b + p)
        # a run with this period goes on to one side of the border at least
        near = (j < top) & (s[i] == s[np.minimum(j, len(s) - 1)])
        near |= (i > bottom) & (s[i - 1] == s[j - 1])
        i, j, p, top = i[near], j[near], p[near], top[near]
        inside = j < top
        ahead = np.zeros(len(i), np.int64)
        ahead[inside] = suffixes.ahead(i[inside], j[inside])
        back = suffixes.back(i, j)
        start, end = i - back, j + ahead
        good = (back + ahead >= p) & (end - start >= shortest)
        found.append(np.stack([start[good], end[good], p[good]], 1))
    rows = np.unique(np.concatenate(found), axis=0)  # of one stretch the smallest period first
    first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.zeros(0, bool)
    return rows[first]


def runs_of(texts: list[list[bytes]], shortest: int = 12) -> list[list[tuple[int, int, int]]]:
    """For each text, a list of words, its runs (start, length, period) by start, then period."""
    if shortest < 2:
        raise ValueError("a run has two words at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some: list[int] = []
    size = 0
    for k, words in enumerate(texts):
        if len(words) >= shortest and has_repeat(words, (shortest + 1) // 2):
            some.append(k)
            size += len(words)
        if some and (size >= CHUNK_WORDS or k == len(texts) - 1):
            for at, runs in zip(some, _together([texts[x] for x in some], shortest), strict=True):
                out[at] = runs
            some, size = [], 0
    if some:
        for at, runs in zip(some, _together([texts[x] for x in some], shortest), strict=True):
            out[at] = runs
    return out


def _together(texts: list[list[bytes]], shortest: int) -> list[list[tuple[int, int, int]]]:
    s = symbols(texts)
    suffixes = Suffixes(s)
    length, source = previous_factors(suffixes)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    starts = [0, *ends[:-1]]
    blocks: list[list[tuple[int, int]]] = []  # of each text: (place, length)
    for low, high in zip(starts, ends, strict=True):
        own, place = [], low
        while place < high:
            own.append((place, max(1, length[place])))
            place += max(1, length[place])
        blocks.append(own)
    borders = [(b, before, after, low, high) for own, low, high in zip(blocks, starts, ends, strict=True) for (b, after), before in zip([*own, (high, 0)], [0, *(n for _, n in own)], strict=True)]
    met = _borders(s, suffixes, *np.array(borders, np.int64).reshape(-1, 5).T, shortest)
    buckets: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
    owner = np.searchsorted(ends, met[:, 0], side="right")
    for k, (start, end, p) in zip(owner.tolist(), met.tolist(), strict=True):
        buckets[k].setdefault(start, []).append((end, p))
    for own, bucket in zip(blocks, buckets, strict=True):
        if not bucket:
            continue
        for place, n in own:
            if n < shortest + 2:
                continue
            copy = source[place]
            shift, last = place - copy, copy + n
            for start in range(copy + 1, last - shortest):
                for end, p in bucket.get(start, ()):
                    if end < last:
                        bucket.setdefault(start + shift, []).append((end + shift, p))
    return [sorted((start - low, end - start, p) for start, held in bucket.items() for end, p in held) for bucket, low in zip(buckets, starts, strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, each run cut to its first period: a word goes if some run
    holds it after that run's first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12, rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of docs: the id, n_words, runs (start, length, period; by start, then period)
    and text, its words joined by one space with every run cut to its first period. ``rewrite``
    (id as text, words) may change the words first.

    Words are stretches without ASCII white space, compared as they are. Null and empty texts have no
    word, no run and an empty text; rows with equal ids or texts each have their own row; a null id
    is kept and is empty text to ``rewrite``. Of one stretch only the smallest period counts; runs
    may overlap. Texts are read whole. An empty table gives no rows. Extra columns are not read."""
    import pyarrow as pa

    def of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        counts, found, kept = [], [], []
        held: list[list[bytes]] = []

        def flush() -> None:
            for words, runs in zip(held, runs_of(held, shortest), strict=True):
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                kept.append(collapsed(words, runs).decode("utf-8"))
            held.clear()

        size = 0
        for doc, text in zip(ids.to_pylist(), bytes_of(texts), strict=True):
            words = text.split()
            held.append(rewrite(doc or "", words) if rewrite else words)
            size += len(words)
            if size >= 4 * CHUNK_WORDS:
                flush()
                size = 0
        flush()
        run = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, run), pa.array(kept, pa.string())], ["n_words", "runs", "text"])

    of.__annotations__ = {"ids": pa.Array, "texts": pa.Array, "return": pa.Array}
    made = by_batch(of, f"n_words long, runs {RUNS}, text string")
    rows = docs.select(F.col(id_col).alias("doc_id"), made(F.col(id_col).cast("string"), F.col(text_col)).alias("r"))
    return rows.select("doc_id", "r.n_words", "r.runs", "r.text")


def planted(doc: str, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, told by their id, with a tail that repeats itself."""
    h, n = crc32(doc.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    times = -(-(n - a) // p)
    return words[:a] + (tail * times)[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # the longest; of equals the smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "runs", best.alias("best"), lines.alias("lines"), "text")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
