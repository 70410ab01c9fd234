"""Decontamination, licence scans and language-model scores against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis.strategies import characters, from_regex

from tests.llm.rows import documents, empty, listed, prose
from tests.oracle import connect, duckdb_rows, spark_rows
from tracewright.llm import decontaminate, licenses, lm
from tracewright.llm.license_rules import ANCHORS, CC_BY, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def plain_leaks(docs, items, threshold=0.8):
    parts = defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").lower())
        if item is not None and words:
            width = min(5, len(words))
            parts[item] |= {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    best = {}
    for doc, text in docs:
        words = WORD.findall((text or "").lower())
        own = {tuple(words[i : i + w]) for w in range(1, 6) for i in range(len(words) - w + 1)}
        for item, need in parts.items():
            n = len(need & own)
            if n >= max(math.ceil(len(need) * threshold - 1e-9), 1):
                best[doc, item] = max(best.get((doc, item), 0), n)
    return sorted(((d, i, len(parts[i]), n, n / len(parts[i])) for (d, i), n in best.items()), key=repr)


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [0, 32_000_000])
def test_leaks(spark, extra, broadcast_bytes):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (5, 6, 9, 20, 60, 150)]
    items = [*enumerate(passages), (10, "two words"), (11, "one"), (12, None), (13, "  "), (None, passages[3]), (3, passages[3]), (14, passages[4].upper())]
    docs = documents(spark, extra)
    made = [(200, "x " + passages[3] + " y"), (201, passages[4].replace(" ", "\n")), (202, passages[2]), (203, "has two  words"), (204, prose(rng, 9000) + " " + passages[5] + " " + prose(rng, 9000))]
    for k, p in enumerate(passages):  # broken passages on both sides of the threshold
        w = p.split()
        for cut in (1, 2, 3, 5, 8, 20, 40):
            made.append((300 + 10 * k + cut, " ".join(x if i % max(2, len(w) // cut) else "zzz" for i, x in enumerate(w))))
            made.append((400 + 10 * k + cut, " ".join(w[: max(1, len(w) - cut)])))
    more = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = plain_leaks(rows, items)
    assert len(expected) > 20
    found = decontaminate.leaks(docs, benchmark, broadcast_bytes=broadcast_bytes)
    assert listed(found, "doc_id", "item_id", "n_shingles", "n_found", "containment") == expected
    kept = decontaminate.clean(docs, benchmark, broadcast_bytes=broadcast_bytes)
    assert kept.columns == docs.columns
    bad = {(d, t) for d, t in rows if plain_leaks([(d, t)], items)}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((x for x in rows if x not in bad), key=repr)


def test_leaks_oracle(spark, sf):
    assert spark_rows(decontaminate.op6_decontamination(spark, sf)) == duckdb_rows(connect(sf), decontaminate.ORACLE)


def test_no_leaks(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(documents(spark), none).count() == 0
    assert decontaminate.leaks(empty(spark), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert decontaminate.clean(documents(spark), none).count() == documents(spark).count()


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_scan(text):
    words = LICENSE_WORD.findall(low(text))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        k = phrase.split()
        for i in range(len(words) - len(k) + 1):
            if words[i : i + len(k)] == k:
                places.append(i)
                base.add(label)
    norm = " " + " ".join(words) + " "
    found = []
    for r in rules():
        if r["keyword"] in norm:
            found += [(m.start(), m.end(), r["priority"], r["label"], r["confidence"]) for m in re.finditer(r["pattern"], norm)]
    kept = []
    for d in sorted(found, key=lambda d: (d[0], -d[1], d[2])):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    labels = base | {d[3] for d in kept}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((d[4] for d in kept), default=0.0)


NOTICES = [
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0", "Released under the MIT License.", "CC BY CC BY cc\nby",
    "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: LGPL-2.1-or-later", "all rights reserved all rights reserved", "General Public\tLICENSE", "the BSD 3-Clause license",
    "accuracy by all rights, reserved. Copyright (c) 2020 by us", "Permission is hereby granted, free of charge, to any person obtaining a copy", "ccby general publiclicense", "éCC BY", "Mozilla Public License 2.0 and the zlib licence",
]


@pytest.mark.parametrize("extra", [False, True])
def test_license_rows(spark, extra):
    docs = documents(spark, extra)
    made = [(200 + k, t) for k, t in enumerate(NOTICES)] + [(300 + k, "some text before. " + t + " And after it, " + NOTICES[-k]) for k, t in enumerate(NOTICES)] + [(400, ("word " * 50 + NOTICES[0] + "\n") * 300), (401, "CC BY, " * 1100 + NOTICES[1])]
    more = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    expected = sorted(((r["doc_id"], *plain_scan(r["text"])) for r in docs.collect()), key=repr)
    assert listed(licenses.scan(docs), *columns) == expected


def test_license_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op8_license_scan(spark, sf).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(texts[r["doc_id"]])


def test_rules_have_anchors():
    assert len(rules()) > 300
    for sample in NOTICES[:4]:
        assert any(a in sample.lower() for a in ANCHORS) or re.search(CC_BY, sample.lower())


@pytest.mark.parametrize("rule", rules(), ids=lambda r: str(r["priority"]))
def test_rules_match_with_their_keyword(rule):
    """Texts made from a rule's pattern hold its keyword and pass the gate."""
    bare = rule["pattern"].removeprefix("(?<= )").removesuffix("(?= )")

    @settings(max_examples=8, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(from_regex(re.compile(bare, re.ASCII), fullmatch=True, alphabet=characters(min_codepoint=32, max_codepoint=126)))
    def holds(text):
        norm = f" {text} "
        assert re.search(rule["pattern"], norm) and re.compile(rule["pattern"]).groups == 0
        assert rule["keyword"] in norm
        assert any(a in text for a in ANCHORS) or re.search(CC_BY, text)

    holds()


def test_rules_are_separate():
    assert len({r["pattern"] for r in rules()}) == len(rules())


def test_no_texts_to_scan(spark):
    assert licenses.scan(empty(spark)).count() == 0


def plain_lm(rows):
    words = [(k, WORD.findall(low(t)) + [None], crc32(("" if k is None else str(k)).encode()) % 7 == 2) for k, t in rows]
    counts = Counter(w for _, ws, out in words if not out for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((k, out, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for k, ws, out in words), key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_lm_base(spark, extra):
    docs = documents(spark, extra)
    expected = plain_lm([(r["doc_id"], r["text"]) for r in docs.collect()])
    found = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in lm.score(docs, block_bytes=40_000).collect()), key=repr)
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    assert np.allclose([x[5] for x in found], [x[5] for x in expected], rtol=1e-9)


def test_lm_blocks_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs, block_bytes=b).collect()) for b in (10**9, 30_000))
    assert one == many


def plain_score(rows):
    """score by dictionaries: EM on the deleted documents, then the mixture of all training counts."""
    docs = [(k, WORD.findall(low(t)) + [None], crc32(("" if k is None else str(k)).encode()) % 7) for k, t in rows]

    def model(use):
        word, pair = Counter(), Counter()
        for _, ws, f in docs:
            if use(f):
                word.update(ws)
                pair.update(zip([None, *ws], ws, strict=False))
        return word, pair, sum(word.values())

    def parts(ws, word, pair, n):
        for a, w in zip([None, *ws], ws, strict=False):
            yield (0 if not word[a] else word[a].bit_length()), pair[a, w] / max(word[a], 1), word[w] / max(n, 1)

    word, pair, n = model(lambda f: f != 2)
    zero = 1 / (len(word) + 1)
    others = model(lambda f: f not in (2, 3))
    cells = Counter()
    for _, ws, f in docs:
        if f == 3:
            cells.update((b, *(lm.NONE if not p else round(math.log10(p) * 20) for p in ps)) for b, *ps in parts(ws, *others))
    weights = {b: [0.0, 0.5, 0.5] if not b else [1 / 3] * 3 for b in range(65)}
    for b in {c[0] for c in cells}:
        own = [([0.0 if x == lm.NONE else 10 ** (x / 20) for x in c[1:]] + [zero], k) for c, k in cells.items() if c[0] == b]
        for _ in range(50):
            new = [0.0] * 3
            for ps, k in own:
                shares = [w * p for w, p in zip(weights[b], ps, strict=True)]
                new = [x + k * y / sum(shares) for x, y in zip(new, shares, strict=True)]
            weights[b] = [x / sum(new) for x in new]
        low_ = [0.0 if not b else 1e-6, 1e-6, 1e-6]
        raised = [max(x, y) for x, y in zip(weights[b], low_, strict=True)]
        weights[b] = [x / sum(raised) for x in raised]
    return [(k, sum(math.log10(sum(w * p for w, p in zip(weights[b], (*ps, zero), strict=True))) for b, *ps in parts(ws, word, pair, n))) for k, ws, _ in docs]


def test_lm_score_against_plain_version(spark, sf):
    for docs in (documents(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        want = sorted(plain_score([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
        got = sorted(((r["doc_id"], r["score"]) for r in lm.score(docs, block_bytes=50_000).collect()), key=repr)
        assert sorted(map(repr, (k for k, _ in want))) == sorted(map(repr, (k for k, _ in got)))
        for k in {k for k, _ in want}:
            assert np.allclose(sorted(x for i, x in want if i == k), sorted(x for i, x in got if i == k), rtol=1e-6)


def test_lm_beats_its_base_on_held_out_text(spark):
    rows = [r for r in lm.op9_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 1.1 * sum(r["base_score"] for r in rows)


def test_lm_probabilities_add_up():
    import pyarrow as pa

    texts = ["a b a b c", "b a", "c c a"]
    block = lm.Block(pa.array(texts), np.ones(3, bool), 4)
    words, pairs = block.own_words, block.own_pairs
    n, v = int(words.sum()), len(words)
    weights = lm.learn([(1, -20, -10, 5), (2, lm.NONE, -10, 3)], 1 / (v + 1))
    assert np.allclose(weights.sum(axis=1), 1)
    for before in range(v):
        share = {int(p % v): c for p, c in zip(block.kept_pairs, pairs, strict=True) if p // v == before}
        w = weights[lm.bucket(words[[before]])[0]]
        total = sum(w[0] * share.get(x, 0) / words[before] + w[1] * words[x] / n + w[2] / (v + 1) for x in range(v)) + w[2] / (v + 1)
        assert total == pytest.approx(1)


def test_counts_as_bytes():
    for counts in ([], [0, 1, 254, 255, 256, 10**12, 3], [255], [7] * 100):
        assert lm.unpack(lm.pack(np.array(counts, np.int64))).tolist() == counts


def test_keys_as_bytes():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.uint64), np.array([2**64 - 1], np.uint64), np.array([0, 0, 2**64 - 1], np.uint64), rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 900, 500, dtype=np.uint64)):
        keys = np.sort(keys)
        found, rest = lm.unpack_keys(lm.pack_keys(keys) + b"rest", len(keys))
        assert found.tolist() == keys.tolist() and rest == b"rest"


def test_no_texts_to_score(spark):
    assert lm.score(empty(spark)).count() == 0
