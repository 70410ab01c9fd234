"""Language-model scoring by deleted interpolation (Jelinek and Mercer, 1980).

A word's probability mixes three estimates: its share after the word before it, its share of all
training tokens, and one over the vocabulary. The mixture's weights depend on how often the word
before was seen (buckets by powers of two) and are learned by expectation-maximisation on deleted
counts: the training documents whose crc32 of the id mod 7 is 3 are scored with the counts of all of
them taken out of the model. That choice, and so every score, depends on the table alone, never on
how documents are dealt to blocks. EM sees probabilities in steps of a twentieth of a decade.

Counting and looking up are one round trip, and nothing that grows with the corpus is broadcast or
collected. Documents are dealt by hash into blocks of about ``block_bytes``, the deleted ones into
blocks of their own. A block sends each of its distinct words and word pairs once, as sorted 64-bit hashes (their steps, in six bytes as a
rule) with its training counts, packed by key range; a key range adds up what all blocks sent and
answers each block in the order asked. The answers are cut to the shared folder and met again with
their block's texts, first for the deleted blocks, then for all. A block, its tables of hashes and
EM's histogram (bucket x two quantised probabilities) have fixed bounds; key ranges grow in number
with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, release, table

HELD_OUT, DELETED = 2, 3  # of crc32 of the id mod 7
BIN = 20  # of a decade of probability, in EM's histogram
NONE = -(10**6)
END = b" end "  # no word has a space


class Block:
    """The words and word pairs of a block of documents."""

    def __init__(self, texts, train: np.ndarray, parts: int) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        full = pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[full]
        self.doc_sizes = np.bincount(doc, minlength=len(texts)).astype(np.int64) + 1
        del doc
        coded = lists.flatten().filter(pa.array(full)).dictionary_encode()
        del lists, full
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in (*coded.dictionary.cast(pa.large_binary()).to_pylist(), END)), np.uint64)
        kinds, end = len(hashes), len(hashes) - 1
        ids = np.full(int(self.doc_sizes.sum()), end, np.int32)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(self.doc_sizes) - 1] = False
        ids[inner] = coded.indices.to_numpy(zero_copy_only=False)
        del coded, inner
        self.ids, self.kinds = ids, kinds
        self.trained = np.repeat(train, self.doc_sizes)
        self.own_words = np.bincount(ids[self.trained], minlength=kinds)
        ordered = self.pairs() * 2 + self.trained  # the lowest bit counts in training
        ordered.sort()
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] >> 1 != ordered[:-1] >> 1))) if len(ordered) else np.zeros(0, np.int64)
        self.own_pairs = np.add.reduceat(ordered & 1, first) if len(first) else first
        self.kept_pairs = ordered[first] >> 1
        del ordered, first
        mixed = hashes[self.kept_pairs // kinds] * np.uint64(0x9E3779B97F4A7C15)
        mixed += hashes[self.kept_pairs % kinds]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sides = [self._order(hashes, parts), self._order(mixed, parts)]

    def before(self) -> np.ndarray:
        """The word before each token; the first word of a document follows an end."""
        out = np.empty_like(self.ids)
        out[1:], out[:1] = self.ids[:-1], self.kinds - 1
        return out

    def pairs(self) -> np.ndarray:
        return self.before().astype(np.int64) * self.kinds + self.ids

    @staticmethod
    def _order(keys: np.ndarray, parts: int) -> tuple:
        """The keys in order, which is by key range too, and where each range begins: the same for
        the same texts in any order."""
        order = np.argsort(keys, kind="stable")
        part = ((keys[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        return keys, order, np.searchsorted(part, np.arange(parts + 1))

    def requests(self, parts: int):
        """(part, keys, counts, how many of them are words) of every key range that is asked."""
        (w, w_order, w_at), (p, p_order, p_at) = self.sides
        for k in range(parts):
            words, pairs = w_order[w_at[k] : w_at[k + 1]], p_order[p_at[k] : p_at[k + 1]]
            if len(words) or len(pairs):
                counts = np.concatenate((self.own_words[words], self.own_pairs[pairs]))
                yield k, pack_keys(w[words]) + pack_keys(p[pairs]), pack(counts), len(words)

    def counts(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The corpus counts of the block's words and pairs, from each key range's answer."""
        (w, w_order, w_at), (p, p_order, p_at) = self.sides
        words, pairs = np.zeros(len(w), np.int64), np.zeros(len(p), np.int64)
        for k, data in answers.items():
            got, a, b = unpack(data), w_order[w_at[k] : w_at[k + 1]], p_order[p_at[k] : p_at[k + 1]]
            if len(got) != len(a) + len(b):
                raise ValueError("an answer does not fit its block")
            words[a], pairs[b] = got[: len(a)], got[len(a) :]
        return words, pairs


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order as their steps, each in as many bytes as the largest step needs."""
    steps = np.diff(keys[1:], prepend=keys[:1]) if len(keys) > 1 else np.zeros(0, np.uint64)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return width.to_bytes(1, "little") + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """(n keys, the bytes behind them)"""
    width, first = data[0], np.frombuffer(data, np.uint64, min(n, 1), 1)
    start = 1 + 8 * len(first)
    end = start + width * max(0, n - 1)
    steps = np.zeros((max(0, n - 1), 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, end - start, start).reshape(-1, width)
    return np.cumsum(np.concatenate((first, steps.reshape(-1).view(np.uint64))), dtype=np.uint64), data[end:]


def pack(counts: np.ndarray) -> bytes:
    """Counts as bytes: one each below 255, and the larger ones in full behind them."""
    big = counts >= 255
    return len(counts).to_bytes(8, "little") + np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype(np.int64).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, 8 + n) if len(data) > 8 + n else out[out == 255]
    return out


def answer(blocks: list[bytes], counts: list[bytes], n_words: list[int], deleted: list[bool]) -> tuple[list[bytes], list[bytes], list[int], int]:
    """Each block's keys with the sums over all blocks and, for deleted blocks, with the sums over
    the others; the training tokens of all and of deleted blocks; the distinct training words."""
    own, keys = [unpack(x) for x in counts], []
    for data, c, n in zip(blocks, own, n_words, strict=True):
        words, rest = unpack_keys(data, n)
        keys.append(np.concatenate((words, unpack_keys(rest, len(c) - n)[0])))
    out, less, tokens, types = [np.zeros(len(k), np.int64) for k in keys], [np.zeros(len(k) * d, np.int64) for k, d in zip(keys, deleted, strict=True)], [0, 0], 0
    for word in (True, False):
        parts = [slice(0, n) if word else slice(n, None) for n in n_words]
        sizes = [len(k[s]) for k, s in zip(keys, parts, strict=True)]
        _, at = np.unique(np.concatenate([k[s] for k, s in zip(keys, parts, strict=True)]), return_inverse=True)
        if not len(at):
            continue
        each = np.concatenate([c[s] for c, s in zip(own, parts, strict=True)])
        sums = np.bincount(at, each).astype(np.int64)
        gone = np.bincount(at, each * np.repeat(deleted, sizes)).astype(np.int64)
        if word:
            tokens, types = [int(sums.sum()), int(gone.sum())], int((sums > 0).sum())
        start = 0
        for o, x, s, n, d in zip(out, less, parts, sizes, deleted, strict=True):
            o[s] = sums[at[start : start + n]]
            if d:
                x[s] = (sums - gone)[at[start : start + n]]
            start += n
    return [pack(o) for o in out], [pack(x) if d else b"" for x, d in zip(less, deleted, strict=True)], tokens, types


def bucket(seen: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one bucket for each power of two."""
    return np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))).astype(np.int64) + 1, 0)


def learn(cells: list[tuple[int, int, int, int]], zero: float, rounds: int = 50) -> np.ndarray:
    """Weights (pair, word, zero) of each bucket by EM over (bucket, bin of pair's probability, bin
    of word's, count). Buckets without a cell, and contexts never seen, split evenly what applies."""
    weights = np.tile(np.array([1.0, 1.0, 1.0]) / 3, (65, 1))
    weights[0] = (0.0, 0.5, 0.5)
    cells = np.array(cells, np.int64).reshape(-1, 4)
    for b in np.unique(cells[:, 0]):
        own = cells[cells[:, 0] == b]
        p = np.stack([*(np.where(own[:, k] == NONE, 0.0, 10.0 ** (own[:, k] / BIN)) for k in (1, 2)), np.full(len(own), zero)], 1)
        for _ in range(rounds):
            share = weights[b] * p
            share /= share.sum(axis=1, keepdims=True)
            weights[b] = (share * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
        weights[b] = np.maximum(weights[b], [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
        weights[b] /= weights[b].sum()
    return weights


def _bins(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(np.log10(np.maximum(p, 1e-300)) * BIN), NONE).astype(np.int64)


def _estimates(block: Block, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple:
    context = words[block.before()]
    pair = pairs[np.searchsorted(block.kept_pairs, block.pairs())] / np.maximum(context, 1)
    return context, pair, words[block.ids] / max(total, 1)


def score(docs: DataFrame | Callable[[], DataFrame], id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs may be a function that gives the rows anew: the passes' plans then share nothing, and the
    shuffle files of one can be deleted before the next begins.

    Documents whose crc32 of the id mod 7 is 2 are held out of all counts. A null or empty text is
    its end token alone; a very long one is part of one block, which grows by it; rows with equal ids
    are documents of their own and all count; a null id counts as the empty id for held_out. Where no
    document trains, every token is unknown; where none is deleted, all estimates weigh the same.
    Ties do not arise: counts have no order. Extra columns are not read. An empty table gives no rows."""
    import pyarrow as pa

    def rows() -> DataFrame:
        found = docs() if callable(docs) else docs
        return found.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), (fold(F.col(id_col), 7) == HELD_OUT).alias("held_out"), (fold(F.col(id_col), 7) == DELETED).alias("deleted"))

    spark = SparkSession.active()
    id_type = dict(rows().dtypes)["doc_id"]
    size = rows().agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    blocks = max(-(-size // block_bytes), min(spark.sparkContext.defaultParallelism, size // 50_000), 1)
    few = max(1, blocks // 7)  # blocks of deleted documents come first
    parts = max(2 * blocks, min(256, size // 50_000), 1)  # narrow ranges make small steps

    def dealt() -> DataFrame:
        place = F.xxhash64("doc_id", "text")
        return rows().withColumn("b", F.when(F.col("deleted"), F.pmod(place, F.lit(few))).otherwise(few + F.pmod(place, F.lit(blocks))).cast("int")).drop("deleted")

    def block_of(texts: pa.Table) -> Block:
        return Block(texts["text"], ~texts["held_out"].to_numpy().astype(bool), parts)

    def ask(group: pa.Table) -> pa.Table:
        block = block_of(group)
        b = group["b"][0].as_py()
        found = list(block.requests(parts))
        return pa.table([pa.array([b] * len(found), pa.int32()), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64())))], ["b", "p", "keys", "counts", "n_words"])

    def reply(group: pa.Table) -> pa.Table:
        deleted = [b < few for b in group["b"].to_pylist()]
        sent, less, tokens, types = answer(group["keys"].to_pylist(), group["counts"].to_pylist(), group["n_words"].to_pylist(), deleted)
        first = [True] + [False] * (len(sent) - 1)
        return pa.table(
            [group["b"], group["p"], pa.array(sent, pa.binary()), pa.array(less, pa.binary()), *(pa.array([n * x for x in first], pa.int64()) for n in (*tokens, types))],
            ["b", "p", "counts", "others", "tokens", "gone", "types"],
        )

    def round_trip() -> DataFrame:
        asked = dealt().groupBy("b").applyInArrow(ask, "b int, p int, keys binary, counts binary, n_words long")
        return cut(asked.groupBy("p").applyInArrow(reply, "b int, p int, counts binary, others binary, tokens long, gone long, types long"))

    answers = round_trip()
    release(spark)
    known = answers.agg(F.sum("tokens").alias("tokens"), F.sum("gone").alias("gone"), F.sum("types").alias("types")).first()
    n_train, n_gone, n_types = known["tokens"] or 0, known["gone"] or 0, known["types"] or 0
    zero = 1 / (n_types + 1)

    def held(group: pa.Table) -> dict[int, bytes]:
        return dict(zip(group["p"].to_pylist(), group["counts"].to_pylist(), strict=True))

    def deleted(texts: pa.Table, replies: pa.Table) -> pa.Table:
        block = block_of(texts)
        words, pairs = block.counts(held(replies))
        context, pair, word = _estimates(block, words, pairs, n_train - n_gone)
        found = np.stack([bucket(context), _bins(pair), _bins(word)], 1)[block.trained]
        cells, n = np.unique(found, axis=0, return_counts=True)
        return pa.table([*(pa.array(cells[:, k]) for k in range(3)), pa.array(n.astype(np.int64))], ["bucket", "pair", "word", "n"])

    some = F.col("b") < few
    others = answers.where(some).select("b", "p", F.col("others").alias("counts"))
    answers = answers.select("b", "p", "counts")
    cells = dealt().where(some).groupBy("b").cogroup(others.groupBy("b")).applyInArrow(deleted, "bucket long, pair long, word long, n long")
    weights = learn([tuple(r) for r in cells.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()], zero)
    del cells
    release(spark)

    def scored(texts: pa.Table, replies: pa.Table) -> pa.Table:
        block = block_of(texts)
        words, pairs = block.counts(held(replies))
        context, pair, word = _estimates(block, words, pairs, n_train)
        of = bucket(context)
        mixed = weights[of, 0] * pair + weights[of, 1] * word + weights[of, 2] * zero
        starts = np.concatenate(([0], np.cumsum(block.doc_sizes)[:-1]))
        sums = [np.add.reduceat(x, starts) for x in (np.log10((words[block.ids] + 1) / (n_train + n_types + 1)), np.log10(mixed), (words[block.ids] > 0).astype(np.int64))]
        n = texts.num_rows
        return pa.table(
            [texts["doc_id"], texts["held_out"], pa.array(block.doc_sizes), pa.array(sums[2]), pa.array(np.full(n, n_train, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    made = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt().groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(scored, made)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(lambda: table(spark, sf_dir, "documents"))
