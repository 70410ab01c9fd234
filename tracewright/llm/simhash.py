"""SimHash near-duplicate groups by a Gray-order hierarchical index.

A fingerprint has 64 bits. Two fingerprints with at most ``max_bits`` = 4 differing bits agree
fully in at least two of six bit blocks, so each pair meets below an upper node "these two blocks
have this pattern": 15 masks, one row per fingerprint and mask. Below an upper node the
fingerprints stand in Gray order (neighbours differ in few bits); runs of 16 and of 16 runs are
nodes that keep the bits all their members share (mask and pattern). Two nodes whose shared bits
differ in more than ``max_bits`` places are pruned with all their members; node pairs that are
already one group are skipped; single fingerprints are compared last.

Each task returns a spanning forest of what it linked (fewer links than fingerprints), never all
pairs, and the forests are joined into components by a distributed star contraction. An upper node
with more than ``node_rows`` fingerprints is taken apart by two more shared blocks of its free bits,
until no node is larger. Equal fingerprints are one row throughout, so exact copies cost nothing.

Fingerprints see only copies that differ in few bits. ``similar`` finds the others: texts whose sets
of five-word shingles have a Jaccard similarity of at least 0.8. One hash of each shingle falls into
one of 160 bins, whose minima (empty bins borrow another's: optimal densification, Shrivastava 2017)
are dealt as 32 bands of 5; a pair at exactly 0.8 shares no band with a probability of about 3e-6,
and pairs that share one are compared on the words themselves.

Very long texts are one row of a task each; a text's words and hashes are held at once, its pairs of
words never.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, by_batch, bytes_of, cut, free_name, release, row_key, table
from .components import components

BLOCKS = (11, 11, 11, 11, 10, 10)
FANOUT = 16
BANDS, BAND_ROWS = 32, 5
BINS = BANDS * BAND_ROWS
WIDTH = 5  # words of a shingle, where a similarity is asked for


def _masks() -> list[int]:
    at, blocks = 0, []
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 with seed 42 of every shingle of a text in UTF-8, in order: words of the text with A-Z
    in lower case, ``width`` consecutive words joined by a space. A text of fewer words is one
    shingle; no word gives none."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    n = len(parts) - width + 1
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    pieces = map(joined.__getitem__, map(slice, starts, ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; no hash gives 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of a text in UTF-8."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(shingle: int = 4, width: int | None = None):
    """A vectorised function from a text column to fingerprints (fp: long, the bits as they are),
    with a width to the band keys of shingles of that many words, and to the number of shingles."""
    import pyarrow as pa

    def of(texts: pa.Array) -> pa.Array:
        codes, bands, n = [], [], []
        for text in bytes_of(texts):
            hashes = shingle_hashes(text, shingle)
            n.append(len(hashes))
            codes.append(_signed(majority(hashes)))
            if width == shingle + 1 and len(hashes) > 1:  # two neighbours make the next longer shingle
                hashes = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1:] ^ (hashes[1:] >> np.uint64(32)))
            elif width and width != shingle + 1:
                hashes = shingle_hashes(text, width)
            bands.append(band_keys(hashes) if width else None)
        return pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["fp", "bands", "n"])

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return by_batch(of, "fp long, bands array<long>, n long")


# ---------------------------------------------------------------- the index of one upper node


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the groups of each a and b made one; labels are the smallest members."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def linked(codes: np.ndarray, max_bits: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(codes in Gray order, label of each: the first position of its group). codes: uint64."""
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    n = len(codes)
    label = np.arange(n)
    both, any_ = [codes], [codes]  # of each node: bits set in all members, bits set in some
    while len(both[-1]) > FANOUT:
        at = np.arange(0, len(both[-1]), FANOUT)
        both.append(np.bitwise_and.reduceat(both[-1], at))
        any_.append(np.bitwise_or.reduceat(any_[-1], at))
    shared = [a | ~o for a, o in zip(both, any_, strict=True)]
    top = len(both) - 1
    i, j = np.triu_indices(len(both[top]))
    near = np.argsort(i - j, kind="stable")  # neighbours in Gray order last: they are taken first
    todo = [(top, i[near], j[near])]
    steps = np.arange(FANOUT)
    spans = [FANOUT**level for level in range(top + 1)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > chunk:
            todo.append((level, i[:-chunk], j[:-chunk]))
            i, j = i[-chunk:], j[-chunk:]
        apart = np.bitwise_count((both[level][i] ^ both[level][j]) & shared[level][i] & shared[level][j])
        close = apart <= max_bits
        i, j = i[close], j[close]
        if not level:
            label = _merge(label, i, j)
            continue
        at = np.arange(0, n, spans[level])
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        new = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j = i[new], j[new]
        if not len(i):
            continue
        a = (i[:, None, None] * FANOUT + steps[None, :, None]).repeat(FANOUT, 2).ravel()
        b = (j[:, None, None] * FANOUT + steps[None, None, :]).repeat(FANOUT, 1).ravel()
        size = len(both[level - 1])
        real = (a < size) & (b < size) & (a <= b if level > 1 else a < b)
        todo.append((level - 1, a[real], b[real]))
    return codes, label


def _small(codes: np.ndarray, run: np.ndarray, most: int, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside many short runs at once: row i with row i + step."""
    out = []
    for step in range(1, most):
        near = (run[step:] == run[:-step]) & (np.bitwise_count(codes[step:] ^ codes[:-step]) <= max_bits)
        at = np.flatnonzero(near)
        if len(at):
            out.append((codes[at], codes[at + step]))
    return out


def _gathered(batches: Iterator, rows: int = 20_000) -> Iterator:
    """Batches put together to about that many rows each."""
    import pyarrow as pa

    some: list = []
    for batch in batches:
        some.append(batch)
        if sum(b.num_rows for b in some) >= rows:
            yield pa.concat_batches(some)
            some = []
    if sum(b.num_rows for b in some):
        yield pa.concat_batches(some)


def _join_nodes(batches: Iterator, max_bits: int) -> Iterator:
    """Batches sorted by (mask, pattern) to links; a node may run on over batches."""
    import pyarrow as pa

    def links(mask, pattern, codes):
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(codes)])))
        out = []
        short = np.repeat((sizes > 1) & (sizes <= FANOUT), sizes)
        if short.any():
            run = np.repeat(np.arange(len(sizes)), sizes)[short]
            out += _small(codes[short], run, int(sizes[(sizes > 1) & (sizes <= FANOUT)].max()), max_bits)
        for start, size in zip(starts[sizes > FANOUT].tolist(), sizes[sizes > FANOUT].tolist(), strict=True):
            ordered, label = linked(codes[start : start + size], max_bits)
            at = np.flatnonzero(label != np.arange(len(label)))
            out.append((ordered[at], ordered[label[at]]))
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
        b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].astype(np.int64)) for k in (0, 1)], ["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in _gathered(batches):
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        last = [c[-1] for c in cols[:2]]
        tail = np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1]))
        split = int(tail[-1]) + 1 if len(tail) else 0
        if held and not split and all(h[0] == x for h, x in zip(held[-1][:2], last, strict=True)):
            held.append(cols)
            continue
        held.append([c[:split] for c in cols])
        done = [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(done[0]) > 1:
            yield links(*done[:2], done[2].astype(np.uint64))
        held = [[c[split:] for c in cols]]
    if held:
        done = [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(done[0]) > 1:
            yield links(*done[:2], done[2].astype(np.uint64))


# ---------------------------------------------------------------- distributed


def _children(mask: int) -> list[int]:
    """The masks below one: its free bits as six blocks, two of them shared as well. Pairs that
    differ in at most four free bits share at least two of the blocks."""
    free = [1 << k for k in range(64) if not mask >> k & 1]
    blocks = [sum(free[len(free) * k // 6 : len(free) * (k + 1) // 6]) for k in range(6)]
    return sorted({mask | a | b for a, b in combinations(blocks, 2)})


def near_links(codes: DataFrame, max_bits: int = 4, node_rows: int = 4096) -> DataFrame:
    """codes(fp long, distinct) to links (a, b) whose components are those of the whole relation
    "at most max_bits bits differ". max_bits may be 0 to 4: six blocks less four leave two.

    Upper nodes of more than node_rows fingerprints are taken apart by the bits that are still
    free, again and again; a node with b free bits has at most 2**b fingerprints, so this ends."""
    if not 0 <= max_bits <= 4:
        raise ValueError("six blocks carry at most 4 differing bits")

    def below(rows: DataFrame, masks: Column) -> DataFrame:
        return rows.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")

    nodes, out = below(codes.select("fp"), F.array(*[F.lit(_signed(m)) for m in _masks()])), None
    while True:
        hot = cut(nodes.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > node_rows).select("mask", "pattern"))
        masks = [r["mask"] for r in hot.select("mask").distinct().collect()]  # 15 for each step down at most
        masks = [m for m in masks if m != -1]
        if not masks:
            out = nodes if out is None else out.unionByName(nodes)
            break
        known = bounded(hot)
        cold = nodes.join(known, ["mask", "pattern"], "left_anti")
        out = cold if out is None else out.unionByName(cold)
        parts = F.broadcast(codes.sparkSession.createDataFrame([(m, [_signed(x) for x in _children(m % (1 << 64))]) for m in masks], "mask long, below array<long>"))
        nodes = cut(below(nodes.join(known, ["mask", "pattern"], "left_semi").join(parts, "mask"), F.col("below")))
    dealt = out.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return dealt.mapInArrow(lambda batches: _join_nodes(batches, max_bits), "a long, b long")


def groups(prints: DataFrame, id_col: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """prints(id, fp) to (fp, component_id, root): the smallest id of the fingerprint's component
    (null ids count only where there is no other) and the component's smallest fingerprint.
    Fingerprints without a link are their own component and move no further."""
    codes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = components(near_links(codes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    joined = cut(codes.join(bounded(cut(roots)), "fp"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = cut(joined.select("fp", "root").join(bounded(cut(least)), "root"))
    placed = codes.join(bounded(members), "fp", "left")
    return placed.select("fp", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    Null texts and texts without a word have fingerprint zero and are one group with each other;
    rows with equal ids each have their own row; a null id is kept, and is the component's id only
    if the component has no other. A bit set in exactly half the shingles is 0. Texts are read whole
    at any length, one at a time. An empty table gives no rows. Extra columns are not read."""
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(shingle)(F.col(text_col))["fp"].alias("fp")))
    placed = groups(prints, "doc_id", max_bits)
    return prints.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, similarity: float | None = None, **how) -> DataFrame:
    """The rows of docs that stay when each near-duplicate group keeps one: the row with the
    smallest id, and of several rows with that id the one with the least row key; of rows equal in
    id and text any one. Null ids stay only where the group has no other. Columns as in docs. With a
    similarity, texts whose five-word shingles are at least that similar are in one group too.

    Null texts and texts without a word are one group. Groups are formed on keys; of the texts only
    rows that have an equal move. An empty table gives no rows."""
    k1, k2, fp = free_name(docs, "k1", "k2", "fp")
    key = row_key(F.col(id_col), F.col(text_col))
    found = fingerprints(shingle, None if similarity is None else WIDTH)(F.col(text_col)).alias("s")
    prints = docs.select(F.col(id_col).alias("doc_id"), key[0].alias("k1"), key[1].alias("k2"), F.xxhash64(F.col(text_col)).alias("t"), found)
    prints = cut(prints.select("doc_id", "k1", "k2", "t", "s.fp", "s.bands", "s.n"))
    placed = cut(groups(prints, "doc_id", max_bits).select("fp", "root"))
    if similarity is not None:
        joined = similar(docs, prints, placed, text_col, similarity, **how)
        placed = placed.join(bounded(joined), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    rows = prints.groupBy("fp", "doc_id", "k1", "k2").agg(F.count("*").alias("n")).join(placed, "fp")
    least = rows.groupBy("root").agg(F.min(order).alias("x"), F.sum("n").alias("n"))
    several = bounded(cut(least.where("n > 1").select("root", F.col("x.k1").alias("s1"), F.col("x.k2").alias("s2"))))
    stays = (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    told = cut(rows.join(several, "root").where(~stays | (F.col("n") > 1)).select(F.col("k1").alias(k1), F.col("k2").alias(k2), stays.alias(fp)))
    keyed = docs.withColumns({k1: key[0], k2: key[1]})
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = keyed.join(bounded(told.drop(fp)), [k1, k2], "left_anti").select(*names)
    equal = told.where(fp).drop(fp)
    if not equal.isEmpty():
        out = out.unionByName(keyed.join(bounded(equal), [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*names))
    return out


# ---------------------------------------------------------------- similar texts


def shingle_set(text: bytes, width: int = 5) -> set[bytes]:
    """The distinct shingles of a text, words as for fingerprints; fewer words are one shingle."""
    parts = text.lower().split()
    return {b" ".join(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1))} if parts else set()


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, for sorted distinct hashes (one at least); an empty bin has that
    of the first full one in a fixed random order of its own."""
    at = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    full, least = at[first], hashes[first]
    if len(full) == BINS:
        return least
    out = np.empty(BINS, np.uint64)
    out[full] = least
    empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
    out[empty] = least[_TURNS[empty[:, None], full].argmin(axis=1)]
    return out


_TURNS = np.stack([np.random.Generator(np.random.PCG64([7, b])).permutation(BINS) for b in range(BINS)]).astype(np.uint16)
_FACTORS, _MIXERS = _odd(BAND_ROWS, 3), _odd(BANDS, 4)


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys, each of its own BAND_ROWS minima of a text's hashed shingles; none for none."""
    if not len(hashes):
        return []
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = np.unique(mixed ^ (mixed >> np.uint64(32)))
    keys = (minima(mixed).reshape(BANDS, BAND_ROWS) * _FACTORS).sum(axis=1, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(31))) * _MIXERS).view(np.int64).tolist()


def _alike(similarity: float, width: int):
    import pyarrow as pa

    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        out, sets = [], lru_cache(maxsize=8)(partial(shingle_set, width=width))
        for x, y in zip(bytes_of(a), bytes_of(b), strict=True):
            x, y = sets(x), sets(y)
            both = len(x & y)
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    of.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return by_batch(of, "boolean")


def alike_in(sets: list[np.ndarray], label: np.ndarray, similarity: float, columns: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): links that join what all pairs of at least that Jaccard similarity join, for sets of
    hashes and their groups so far. Shared members are counted by products of blocks of the
    membership matrix, so all pairs are exact and none is a row."""
    sizes = np.array([len(x) for x in sets])
    members, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(members)) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(often.sum()), columns):
        part = slice(*np.searchsorted(column, (at, at + columns)))
        block = np.zeros((len(sets), columns), np.float32)
        block[row[part], column[part] - at] = 1
        both += block @ block.T
    ends = []
    for at in range(0, len(sets), 512):
        some = slice(at, at + 512)
        near = both[some] >= similarity * (sizes[some, None] + sizes[None] - both[some]) - 1e-4
        x, y = np.nonzero(near & (label[some, None] != label[None]))
        ends.append((x + at, y))
    i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
    first = np.unique(label, return_index=True, return_inverse=True)[2]
    merged = _merge(np.arange(len(sets)), first[i], first[j])
    least = np.full(len(sets), -1)
    least[first[::-1]] = np.arange(len(sets))[::-1]
    a = np.flatnonzero(merged != np.arange(len(sets)))
    return least[a], least[merged[a]]


def _hashed(width: int):
    import pyarrow as pa

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(x, width)).view(np.int64) for x in bytes_of(texts)], pa.list_(pa.int64()))

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return by_batch(of, "array<long>")


def similar(docs: DataFrame, prints: DataFrame, roots: DataFrame, text_col: str, similarity: float, width: int = WIDTH, few: int = 8, bucket_rows: int = 4096, part_shingles: int = 1_000_000, part_rows: int = 2048) -> DataFrame:
    """roots(fp, root) to (root, top): the groups that texts of at least that similarity join, for
    groups that are joined to another. prints has t (hash of the text), fp and bands.

    Only texts of different groups that share a band (a bucket) are compared; in a bucket of at most
    ``few`` texts all of them. In a larger one the text with the most company is compared with the
    others first: the centre of a family of copies shares more bands with its copies than they do
    with each other, so this joins most of a family by as many pairs as it has texts, and buckets of
    one group are done. What is left of a bucket is compared as a whole, on its texts' hashed
    shingles; one of more than ``bucket_rows`` texts is first taken apart by a second and a third
    shared band (a pair at exactly 0.8 lacks these with a probability of 4e-4), and one of more than
    ``part_shingles`` or ``part_rows`` is dealt as pairs of parts, so a task's work and its matrix of
    shared shingles (of two parts at once) are bounded however short the texts are."""
    import pyarrow as pa

    spark = docs.sparkSession
    texts = cut(prints.where(F.size("bands") > 0).groupBy("t").agg(F.min("fp").alias("fp"), F.any_value("bands").alias("bands"), F.max("n").alias("shingles")).join(roots, "fp").select("t", "root", "shingles", "bands"))

    def mixed(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        return cut(rows.join(bounded(cut(several)), "key"))

    def joined(found: DataFrame | None, ends: DataFrame) -> DataFrame | None:
        """The groups with further links (a, b) between roots."""
        ends = cut(ends.where("a <> b").distinct())
        if ends.isEmpty():
            return found
        return cut(components(ends if found is None else ends.unionByName(found.toDF("a", "b"))).toDF("root", "top"))

    def renamed(rows: DataFrame, found: DataFrame | None) -> DataFrame:
        return rows if found is None else rows.join(bounded(found), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")

    held = mixed(texts.select("t", "root", "shingles", F.posexplode("bands").alias("at", "key")))
    if held.isEmpty():
        return roots.select("root", F.col("root").alias("top")).where("false")
    sizes = cut(held.groupBy("key").agg(F.count("*").alias("n")))
    company = cut(held.join(bounded(sizes), "key").groupBy("t").agg(F.sum("n").alias("company")))
    bands = cut(texts.join(bounded(company), "t").select("t", "root", "bands"))
    source = docs.select(F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    source = cut(source.join(bounded(company.select("t")), "t", "left_semi").dropDuplicates(["t"]))
    release(spark)

    small = held.join(bounded(sizes.where(F.col("n") <= few).select("key")), "key", "left_semi")
    small = small.drop("shingles", "at").join(small.select("key", F.col("t").alias("t2"), F.col("root").alias("root2")), "key")
    large = held.join(bounded(sizes.where(F.col("n") > few).select("key")), "key", "left_semi")
    centre = large.join(bounded(company), "t").groupBy("key").agg(F.max(F.struct("company", "t", "root")).alias("x"))
    centre = cut(centre.select("key", F.col("x.t").alias("t2"), F.col("x.root").alias("root2")))
    large = large.join(bounded(centre), "key").where("t <> t2")
    met = small.unionByName(large.select(*small.columns)).where("root <> root2")
    pairs = cut(met.select(F.least("t", "t2").alias("a"), F.greatest("t", "t2").alias("b")).distinct())
    near = bounded(pairs)
    one = source.join(near, F.col("t") == F.col("a")).select("a", "b", F.col("text").alias("x"))
    two = source.join(near, F.col("t") == F.col("b")).select("a", "b", F.col("text").alias("y"))
    good = bounded(cut(one.join(two, ["a", "b"]).where(_alike(similarity, width)("x", "y")).select("a", "b")))
    of = bands.select("t", "root")
    found = joined(None, good.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))

    held, left = mixed(renamed(large.select("t", "root", "shingles", "at", "key"), found)), None
    for turn in range(3):
        sizes = cut(held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > (bucket_rows if turn < 2 else 0)))
        if sizes.isEmpty():
            break
        rest = held.join(bounded(sizes), "key", "left_anti")
        left = rest if left is None else left.unionByName(rest)
        wide = held.join(bounded(sizes.select("key")), "key", "left_semi")
        if turn < 2:
            wide = wide.join(bounded(bands.select("t", "bands")), "t").select("t", "root", "shingles", "key", F.col("at").alias("after"), F.posexplode("bands").alias("at", "band"))
            held = mixed(wide.where("at > after").select("t", "root", "shingles", "at", F.xxhash64("key", "band").alias("key")))
    left = held if left is None else left.unionByName(held)
    left = cut(left.select("t", "root", "shingles", "key"))
    if left.isEmpty():
        return roots.select("root", F.col("root").alias("top")).where("false") if found is None else found
    wanted = source.join(bounded(cut(left.select("t").distinct())), "t", "left_semi")
    sets = cut(wanted.select("t", _hashed(width)("text").alias("hashes")))
    weights = left.groupBy("key").agg(F.greatest(F.ceil(F.sum("shingles") / part_shingles), F.ceil(F.count("*") / part_rows)).cast("int").alias("parts"))
    home = F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
    pair = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (j != home) | (F.col("parts") == 1)), lambda j: (F.least(j, home) * F.col("parts") + F.greatest(j, home)).cast("int"))
    dealt = left.join(bounded(cut(weights)), "key").select("key", "t", "root", F.explode(pair).alias("part")).join(sets, "t")

    def compared(group: pa.Table) -> pa.Table:
        order = np.argsort(group["t"].to_numpy(), kind="stable")
        label = group["root"].to_numpy()[order]
        hashes = group["hashes"].combine_chunks().take(pa.array(order))
        values, ends = hashes.flatten().to_numpy(), np.cumsum(hashes.value_lengths().to_numpy())
        i, j = alike_in(np.split(values, ends[:-1]), label, similarity)
        return pa.table([pa.array(label[i]), pa.array(label[j])], ["a", "b"])

    found = joined(found, dealt.select("key", "part", "t", "root", "hashes").groupBy("key", "part").applyInArrow(compared, "a long, b long"))
    release(spark)
    return roots.select("root", F.col("root").alias("top")).where("false") if found is None else found


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
