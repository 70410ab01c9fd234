"""Periodic runs against a search of every period."""

import hashlib
import random
from zlib import crc32

from tests.llm.rows import documents, empty, listed
from tracewright.llm import runs


def plain_runs(w, shortest=12):
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(shortest, 2 * p):
                best.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_words(doc, text):
    words = (text or "").encode().split()
    h, n = crc32(("" if doc is None else str(doc)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc, text):
    words = plain_words(doc, text)
    found = plain_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    milli = 1000 * top[1] // top[2] if found else None
    return doc, len(found), *top, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_random_texts():
    rng = random.Random(1)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.randint(0, 80), rng.choice([1, 2, 3, 20])
            w = [str(rng.randint(0, letters)).encode() for _ in range(n)]
            if rng.random() < 0.5 and n:
                w = runs.planted(str(rng.randint(0, 10**6)), w)
            if rng.random() < 0.3 and n:
                w = w[: n // 3] + w[: rng.randint(1, 8)] * 9 + w[n // 3 :]
                w = w + w[: len(w) // 2]
            texts.append(w)
        shortest = rng.choice([2, 3, 4, 12])
        assert runs.runs_of(texts, shortest) == [plain_runs(w, shortest) for w in texts]


def test_texts_with_many_runs_and_long_blocks():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(12):
        a, b = b, b + a  # Fibonacci words
    thue = [b"0"]
    for _ in range(9):
        thue = thue + [b"1" if x == b"0" else b"0" for x in thue]
    base = [str(k % 37 * (k % 5)).encode() for k in range(200)]
    texts = [b, thue, [b"x"] * 700, base * 4 + base[:50], (base + [b"x"] * 13 + base) * 3, [b"x", b"y"] * 300 + [b"z"] + [b"x", b"y"] * 300]
    for shortest in (2, 12):
        assert runs.runs_of(texts, shortest) == [plain_runs(w, shortest) for w in texts]


def test_rows(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(runs, "table", lambda *a: table)
    expected = sorted((plain_row(r["doc_id"], r["text"]) for r in table.collect()), key=repr)
    assert listed(runs.op12_periodic_runs(spark, sf), *COLUMNS) == expected
    assert sum(r[1] > 0 for r in expected) > 10
    for extra in (False, True):
        table = documents(spark, extra).unionByName(spark.createDataFrame([(300 + k, "one two " * 9 * k, "en", "s", 1) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
        expected = sorted((plain_row(r["doc_id"], r["text"]) for r in table.where("coalesce(length(text), 0) < 60000").collect()), key=repr)
        found = runs.op12_periodic_runs(spark, sf)
        assert found.count() == table.count()
        assert [r for r in listed(found, *COLUMNS) if r[0] != 103] == expected
    table = empty(spark)
    assert runs.op12_periodic_runs(spark, sf).count() == 0


def test_operator_gives_spans_and_text(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 6 + "y"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.repeated_runs(df).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 18, 3)] and got[1]["text"] == "x a b c y" and got[1]["n_words"] == 20
    assert got[2]["runs"] == [] and got[2]["text"] == "" and got[2]["n_words"] == 0
