import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.llm.rows import documents, empty, labels, listed
from tracewright.llm import quality, rules

DATA = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1.0
    for v in np.unique(s):
        order[s == v] = order[s == v].mean()
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def held_out(spark, found, column):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [(truth[r["doc_id"]], float(r[column])) for r in found.collect() if r["doc_id"] in truth and crc32(str(r["doc_id"]).encode()) % 3 == 1]
    return np.array([y for y, _ in rows]), np.array([s for _, s in rows])


def test_quality_is_learned(spark):
    found = quality.op1_quality_classifier(spark, DATA)
    y, s = held_out(spark, found, "score")
    assert auc(y, s) > 0.97
    assert ((s >= 0.5) == y).mean() > 0.9
    assert found.where("held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)").count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_quality_rows(spark, extra):
    docs = documents(spark, extra)
    found = quality.score(docs, labels(spark))
    assert listed(found, "doc_id") == listed(docs, "doc_id")
    rows = found.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    bias = {r["score"] for r in rows if r["doc_id"] in (100, 101, 102)}
    assert len(bias) == 1
    assert quality.keep(docs, labels(spark)).columns == docs.columns


def test_quality_without_rows(spark):
    assert quality.score(empty(spark), labels(spark)).count() == 0
    none = labels(spark).where("false")
    assert {r["score"] for r in quality.score(documents(spark), none).collect()} == {0.5}


def test_held_out_labels_are_not_read(spark):
    docs = documents(spark)
    turned = labels(spark).selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) quality")
    assert listed(quality.score(docs, labels(spark)), "doc_id", "score") == listed(quality.score(docs, turned), "doc_id", "score")


def test_sparse_dot_product():
    weights = np.arange(1 << 10, dtype=np.float32)
    found = quality.features(b"a b !! b b", 10)
    assert len(found) == 9 and (found == quality.STUTTER).sum() == 1
    assert quality.features(b"", 10).size == 0
    assert weights[found].sum() == sum(found.tolist())


def plain_quality(docs, truth, bits=18, epochs=4, alpha=0.3, beta=1.0, l1=0.002, l2=0.05):
    """Scores by the update rule of follow-the-regularised-leader, weight by weight."""
    mult, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def features(text):
        one = [crc32(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())]
        found = Counter(((t * mult) & mask) >> (64 - bits) for t in one)
        for a, b in zip(one, one[1:]):
            found[1 if a == b else ((((a * 0xC2B2AE3D27D4EB4F + b) & mask) * mult) & mask) >> (64 - bits)] += 1
        total = max(1, sum(found.values()))
        return {k: c / total**0.5 for k, c in found.items()}

    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + n[k] ** 0.5) / alpha + l2)

    rows = [(features(text) | {"bias": 1.0}, truth[i]) for i, text in sorted(docs.items(), key=lambda d: (crc32(str(d[0]).encode()), d[0])) if i in truth and crc32(str(i).encode()) % 3 != 1]
    for _ in range(epochs):
        for x, y in rows:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                more = n[k] + g * g
                z[k] += g - (more**0.5 - n[k] ** 0.5) / alpha * w[k]
                n[k] = more
    return {i: 1 / (1 + math.exp(-weight("bias") - sum(weight(k) * v for k, v in features(text).items()))) for i, text in docs.items()}


def test_quality_is_the_plain_rule(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    expected = plain_quality(docs, truth)
    found = {r["doc_id"]: r["score"] for r in quality.op1_quality_classifier(spark, sf).collect()}
    assert found.keys() == expected.keys() and max(abs(found[k] - expected[k]) for k in found) < 1e-5


def test_counted_features_are_bounded():
    packed = quality.counted(b"a b c " * 50_000, 6)
    at, count = np.frombuffer(packed, np.int32).reshape(2, -1)
    assert len(at) <= 1 << 6 and count.sum() == 299_999


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


@pytest.mark.parametrize("extra", [False, True])
def test_rule_counts(spark, extra):
    docs = documents(spark, extra)
    more = spark.createDataFrame([(900, "a b c d e f a b c d e g\nline\nline\n\nline \n#$ %", "en", "x", 1), (901, "x " * 40, "en", "x", 1), (902, "é é ü ß " * 3, "en", "x", 1)], docs.schema if not extra else "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    rows = rules.judge(docs, labels(spark)).collect()
    expected = sorted(((r["doc_id"], *plain_counts(r["text"])) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], *[r[c] for c in rules.COUNTS[:5]]) for r in rows), key=repr) == expected
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_rules_catch_junk_and_keep_prose(spark):
    found = rules.op3_quality_rules(spark, DATA)
    y, kept = held_out(spark, found.where("not base_failed"), "kept")
    assert kept[y == 1].mean() > 0.99
    assert kept[y == 0].mean() < 0.1


def test_rules_without_rows(spark):
    assert rules.judge(empty(spark), labels(spark)).count() == 0
    found = rules.judge(documents(spark), labels(spark).where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in found)
    assert rules.keep(documents(spark), labels(spark)).columns == documents(spark).columns


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(6 * x[:, 1]) + 0.3 * rng.standard_normal(3000)) < 0.6).astype(float)
    trees = rules.boost(x, y, monotone=(-1, 0, 0), n_trees=40)
    grid = np.repeat(rng.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    scores = trees.margin(grid).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert np.allclose([walk(r) for r in grid[:60]], trees.margin(grid[:60]))
