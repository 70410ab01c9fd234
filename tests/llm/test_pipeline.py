"""Every stage of the pipeline against a plain version of it."""

from collections import Counter, defaultdict

import pytest

from tests.llm.rows import documents, labels, prose
from tests.llm.test_mixing_sharding import plain_targets
from tests.llm.test_search import plain_leaks
from tests.llm.test_simhash import plain_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_in_turn(spark, sf, pipeline):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in pipeline.STAGES:
        kept[name] = (docs, stage(spark, docs, sf).cache())
        docs = kept[name][1]
        assert docs.columns[:5] == COLUMNS
    before, after = kept["quality_rules"]
    from tracewright.llm import rules

    verdict = rules.judge(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in verdict.where("kept").collect())
    assert 0 < after.count() < before.count()

    before, after = kept["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in after.collect()) == plain_kept(pairs(before))

    before, after = kept["decontamination"]
    bad = {d for d, *_ in plain_leaks(pairs(before), items)}
    assert pairs(after) == [x for x in pairs(before) if x[0] not in bad]

    before, after = kept["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before.collect():
        sizes[r["source"]] += len(r["text"].split())
    copies = Counter(r["doc_id"] for r in after.collect())
    for r in after.collect():
        taken[r["source"]] += len(r["text"].split())
    assert max(copies.values()) <= 3
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= max(len(r["text"].split()) for r in before.collect() if r["source"] == source)

    before, after = kept["sharding"]
    assert pairs(after) == pairs(before)
    slots = defaultdict(list)
    for r in after.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run(spark, sf, pipeline):
    found = pipeline.run(spark, sf)
    assert found.columns[:5] == COLUMNS and found.count() > 50


def test_rows_that_operators_stumble_over(spark, sf, pipeline, tmp_path):
    docs = documents(spark, extra=True).drop("text_crc32", "shard", "size")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(__import__("random").Random(3), 30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (docs, docs.where("false")):
        for _, stage in pipeline.STAGES:
            data = stage(spark, data, str(tmp_path))
        rows = data.collect()
    assert rows == []


def test_stages_on_awkward_rows(spark, pipeline, tmp_path):
    """Each stage by itself on null, empty, very long, repeated and clashing rows."""
    from tracewright.llm import rules

    docs = documents(spark, extra=True).cache()
    rows = pairs(docs)
    leak = " ".join(max((t or "" for _, t in rows), key=len).split()[700:740])
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {name: stage(spark, docs, str(tmp_path)).cache() for name, stage in pipeline.STAGES}
    for name in list(found)[:4]:
        assert found[name].columns == docs.columns

    verdict = rules.judge(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("kept")
    assert sorted((r["doc_id"] for r in found["quality_rules"].collect()), key=repr) == sorted((r["doc_id"] for r in verdict.collect()), key=repr)

    assert found["simhash_near_dedup"].count() == len(plain_kept([(k, t) for k, (_, t) in enumerate(rows)]))

    bad = {k for k, *_ in plain_leaks([(k, t) for k, (_, t) in enumerate(rows)], [(1, leak), (2, None)])}
    assert bad and pairs(found["decontamination"]) == [x for k, x in enumerate(rows) if k not in bad]

    times = Counter(pairs(found["mixing"]))
    own = Counter(rows)
    assert all(x in own and n <= 3 * own[x] and (x[1] or "").split() for x, n in times.items())

    assert pairs(found["sharding"]) == rows
    slots = defaultdict(list)
    for r in found["sharding"].collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_library_stands_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    from tracewright.plans import registry

    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES)), "False"], said.stderr
