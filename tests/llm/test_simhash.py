import re

import numpy as np
import pytest
import xxhash

from tests.llm.rows import documents, empty, listed
from tracewright.llm import components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, bits):
    codes = np.array(codes, np.uint64)
    label = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= bits
    while True:
        new = np.array([label[near[k]].min() for k in range(len(codes))])
        if (new == label).all():
            return label
        label = new


def plain(rows):
    codes = [plain_fingerprint(t) for _, t in rows]
    label = plain_groups(codes, 4)
    ids = {}
    for (k, _), g in zip(rows, label, strict=True):
        if k is not None:
            ids[g] = min(ids.get(g, k), k)
    return sorted(((k, f"{c:016x}", ids.get(g)) for (k, _), c, g in zip(rows, codes, label, strict=True)), key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(spark, extra):
    docs = documents(spark, extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert listed(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == plain(rows)


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert listed(simhash.op2_simhash_near_dedup(spark, sf), "doc_id", "fingerprint", "component_id") == plain(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = documents(spark, extra=True)
    found = simhash.near_duplicates(docs)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in found.collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len(groups)
    assert set(ids) == groups


def clustered(rng, n, centres, flips):
    base = rng.integers(0, 2**63, centres, dtype=np.uint64)
    codes = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(codes)


@pytest.mark.parametrize("seed", range(12))
def test_index_of_one_node(seed):
    rng = np.random.default_rng(seed)
    codes = clustered(rng, int(rng.integers(2, 900)), int(rng.integers(1, 30)), int(rng.integers(1, 6)))
    ordered, label = simhash.linked(codes, 4, chunk=64)
    expected = plain_groups(ordered, 4)
    assert len(set(zip(label.tolist(), expected.tolist(), strict=True))) == len(set(label.tolist())) == len(set(expected.tolist()))


def test_hot_nodes_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(3)
    codes = np.unique(np.concatenate([clustered(rng, 1500, 1, 5), clustered(rng, 500, 100, 3)]))
    df = spark.createDataFrame([(int(c.astype(np.int64)),) for c in codes], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_links(df, node_rows=40)).collect()}
    expected = plain_groups(codes, 4)
    got = [roots.get(int(c.astype(np.int64)), int(c.astype(np.int64))) for c in codes]
    assert len(set(zip(got, expected.tolist(), strict=True))) == len(set(got)) == len(set(expected.tolist()))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1080), 1000), 2000: 2000, 2001: 2000}


def plain_kept(rows):
    """The ids that stay: all pairs by four bits or an exact Jaccard similarity of 0.8."""
    sets = [simhash.shingle_set((t or "").encode()) for _, t in rows]
    codes = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and ((codes[i] ^ codes[j]).bit_count() <= 4 or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) > 0):
                label = [label[j] if x == label[i] else x for x in label]
    return sorted({min(k for (k, _), g in zip(rows, label, strict=True) if g == x) for x in label})


@pytest.mark.parametrize("family", [6, 60])
def test_stage_joins_copies_that_fingerprints_cannot_see(spark, family):
    """Copies with 1 to 10 scattered changes in 200 words, against all pairs' exact similarity."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(family)
    rows = []
    for base in range(5):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for copy in range(family if not base else 8):
            own = list(words)
            for at in rng.integers(0, 200, copy % 11):
                own[at] = f"c{base}x{copy}x{at}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, rows[0][1])]
    want = plain_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()) == want
    assert len(want) < simhash.keep_one(docs).count()
    if family == 60:  # every bucket is large, taken apart and dealt as pairs of parts
        found = simhash.keep_one(docs, similarity=0.8, few=0, bucket_rows=40, part_shingles=3000)
        assert sorted(r["doc_id"] for r in found.collect()) == want


@pytest.mark.parametrize("seed", range(6))
def test_sets_of_a_bucket_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))) for _ in range(80)]
    label = rng.integers(0, 70, 80)
    i, j = simhash.alike_in(sets, label, 0.6, columns=16)
    got, want = label.copy(), label.copy()
    for x, y in zip(i, j, strict=True):
        got[got == got[x]] = got[y]
    for x in range(80):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if both >= 0.6 * (len(sets[x]) + len(sets[y]) - both):
                want[want == want[x]] = want[y]
    assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == len(set(got.tolist())) == len(set(want.tolist()))


def test_memory_of_a_bucket_of_short_texts():
    """The largest matrix that a task may hold: two parts of the default number of short texts."""
    import inspect
    import tracemalloc

    rows = 2 * inspect.signature(simhash.similar).parameters["part_rows"].default
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2000, 30)) for _ in range(int(1.1 * rows))]
    tracemalloc.start()
    simhash.alike_in(sets, np.arange(len(sets)), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000


def test_many_short_texts_in_one_bucket(spark):
    """More texts than a part holds, all alike enough to share bands, against all pairs."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        words = [f"w{x}" for x in range(34)]
        for at in rng.integers(0, 34, k % 3):
            words[at] = f"c{k}x{at}"
        rows.append((k, " ".join(words)))
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8, few=0, part_rows=50)
    assert sorted(r["doc_id"] for r in found.collect()) == plain_kept(rows)
