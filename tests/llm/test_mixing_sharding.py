import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import documents, empty, listed
from tracewright.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """sizes by source; targets by filling again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("extra", [False, True])
def test_mix(spark, extra):
    docs = documents(spark, extra)
    rows = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    expected = plain_targets(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] if r["size"] else r["taken"] == 0
        taken[r["source"]] += r["taken"]
    for source, target in expected.items():
        largest = max(r["size"] for r in rows if r["source"] == source)
        assert abs(taken[source] - target) <= largest
    assert listed(mixing.mix(docs), "doc_id", "size", "taken") == listed(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken")


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"s{int(rng.integers(0, 9)) if k % 3 else 0}", int(x)) for k, x in enumerate(rng.lognormal(4, 1.3, 6000))]
    found = mixing.decide(spark.createDataFrame(rows, "doc_id long, source string, size long"), fan_in=16)
    per = found.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per) == 6000
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in per)


def test_mix_keeps_expectations(spark):
    rows = [(k, "a" if k < 40 else "b", 10 + k % 7) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    copies = Counter()
    for seed in range(6):
        for r in mixing.decide(df, seed=seed).where("source = 'b'").collect():
            copies[r["doc_id"]] += r["whole"] + r["extra"]
    assert len({r for r in copies.values()}) > 1  # chance is at work
    target = mixing.targets(df).where("source = 'b'").first()
    assert sum(copies.values()) / 6 / 40 == pytest.approx(target["target"] / target["source_size"], rel=0.1)


def test_mix_repeats_rows(spark):
    docs = documents(spark, extra=True)
    twice = docs.unionByName(docs.where("doc_id < 10"))
    out = mixing.repeat_rows(twice)
    assert out.columns == docs.columns
    expected = Counter()
    for r in mixing.mix(twice).collect():
        expected[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +expected


def test_nothing_to_mix(spark):
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert listed(mixing.mix(blank), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def plain_jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        ahead = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def test_jump():
    keys = np.random.default_rng(0).integers(0, 2**64, 4000, dtype=np.uint64)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


@pytest.mark.parametrize("extra", [False, True])
def test_shards(spark, extra):
    docs = documents(spark, extra)
    rows = sharding.place(docs, bucket_rows=2).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    shard_of = {}
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.place(docs.repartition(5), bucket_rows=2)
    assert listed(again, "doc_id", "shard", "slot", "text_crc32") == sorted(((r["doc_id"], r["shard"], r["slot"], r["text_crc32"]) for r in rows), key=repr)


def test_growing_moves_a_ninth(spark, sf):
    rows = sharding.op7_sharding(spark, sf).collect()
    assert 0.02 < sum(r["grown_shard"] == 8 for r in rows) / len(rows) < 0.25


def test_no_rows_to_shard(spark):
    assert sharding.place(empty(spark)).count() == 0
