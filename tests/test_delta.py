"""Graphs kept up by changes against graphs built anew."""

import random

from tests.test_shapes import group, record, tables
from tracewright.functions.lineage import Scratch
from tracewright.operators import delta, model_graph
from tracewright.operators.flow_graph import hyperedges, incidences

MAKERS = ["JobGateway", "PostSynchronizationManager", "AlignmentManager"]


def bag(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def random_record(rng, name, n):
    """Parents, children and groups may be missing, repeat or be the record itself."""
    some = lambda most: [f"r{rng.randrange(n + 3)}" for _ in range(rng.randrange(most))]
    owner = rng.choice([None, f"g{rng.randrange(n // 3 + 2)}"])
    begin = rng.randrange(2)
    return record(name, rng.choice(MAKERS), some(4), some(3), owner, rng.choice("ab"), begin, begin + 1)


def random_group(rng, name, n):
    return group(name, rng.choice(MAKERS[1:]), [f"r{rng.randrange(n + 3)}" for _ in range(rng.randrange(4))], rng.choice("ab"))


def random_job(rng, name, n):
    return {"_id": name, "input_dsars": [f"g{rng.randrange(n // 3 + 2)}" for _ in range(rng.randrange(3))], "output_dsir": f"r{rng.randrange(n)}", "model_type": rng.choice("ab"), "relevance": rng.random()}


def built(spark, docs):
    """The tables of documents by name, with job numbers that stay."""
    t = tables(spark, list(docs["r"].values()), list(docs["g"].values()), list(docs["j"].values()))
    names = spark.createDataFrame([(k, int(name[1:])) for k, name in enumerate(sorted(docs["j"]))], "job_id long, own long")
    for name in ("job", "job_dsar"):
        t[name] = t[name].join(names, "job_id").drop("job_id").withColumnRenamed("own", "job_id").select(*t[name].columns)
    return t


def whole(t):
    rows = incidences(t)
    return bag(rows), bag(hyperedges(t, rows).drop("weight")), bag(model_graph.nodes(t)), bag(model_graph.edges(t))


def stored(graphs):
    return bag(graphs.rows.read().drop("owner")), bag(graphs.edges.read().drop("owner", "weight")), bag(graphs.nodes.read()), bag(graphs.links.read())


def change(rng, docs, n):
    """Changes some documents, adds some and takes some out; the changed ones and the ids that went."""
    new, gone = {"r": {}, "g": {}, "j": {}}, {"r": [], "g": [], "j": []}
    makers = {"r": random_record, "g": random_group, "j": random_job}
    for kind, most in (("r", n + 2), ("g", n // 3 + 2), ("j", n // 2)):
        for k in rng.sample(range(most), 2):
            name = f"{kind}{k}"
            if name in docs[kind] and rng.random() < 0.3:
                del docs[kind][name]
                gone[kind].append(name)
            else:
                new[kind][name] = docs[kind][name] = makers[kind](rng, name, n)
    return new, gone


def as_ids(spark, gone):
    frames = {"dsir_id": [(x,) for x in gone["r"]], "dsar_id": [(x,) for x in gone["g"]], "job_id": [(int(x[1:]),) for x in gone["j"]]}
    return {c: spark.createDataFrame(rows, f"{c} {'long' if c == 'job_id' else 'string'}") for c, rows in frames.items()}


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng, n = random.Random(1), 40
    docs = {"r": {f"r{k}": random_record(rng, f"r{k}", n) for k in range(n)}, "g": {f"g{k}": random_group(rng, f"g{k}", n) for k in range(n // 3)}, "j": {f"j{k}": random_job(rng, f"j{k}", n) for k in range(n // 2)}}
    graphs = delta.StoredGraphs(spark, f"file://{tmp_path}/graphs", 4)
    graphs.build(built(spark, docs))
    assert stored(graphs) == whole(built(spark, docs))
    for _ in range(2):
        new, gone = change(rng, docs, n)
        made = graphs.change(built(spark, new), as_ids(spark, gone))
        assert 0 < sum(made.values())
        t = built(spark, docs)
        assert stored(graphs) == whole(t)
        assert {name: bag(df) for name, df in graphs.tables.read().items()} == {name: bag(df) for name, df in t.items()}


def test_touched_by_one_record(spark):
    """A late parent reaches the groups whose edge hangs on it, and no others; plain tables will do."""
    t = tables(
        spark,
        [record("run", MAKERS[0]), record("p1", MAKERS[1], ["run"], dsar="M1"), record("a1", MAKERS[2], ["p1"], dsar="S1"), record("run2", MAKERS[0], ["a1"]), record("p2", MAKERS[1], ["run2"], dsar="M2")],
        [group("M1", MAKERS[1], ["p1"]), group("S1", MAKERS[2], ["a1"]), group("M2", MAKERS[1], ["p2"])],
        [{"_id": "j", "input_dsars": ["S1"], "output_dsir": "run2", "model_type": "m", "relevance": 0.5}],
    )
    wanted = lambda **of: {c: spark.createDataFrame([(x,) for x in of.get(c, [])], f"id {'long' if c == 'job_id' else 'string'}") for c in ("dsir_id", "dsar_id", "job_id")}
    with Scratch(spark) as keep:
        found = delta.touched(delta.over(t), wanted(dsir_id=["run"]), keep)
        assert {k: bag(v) for k, v in found.items()} == {"aligned": [], "runs": [], "synced": [("M1",)], "nodes": [("p1",), ("run",)]}
        found = delta.touched(delta.over(t), wanted(dsir_id=["p1"]), keep)
        assert {k: bag(v) for k, v in found.items()} == {"aligned": [("S1",)], "runs": [], "synced": [("M1",)], "nodes": [("a1",), ("p1",)]}  # run2 names p1, whatever p1 is
        rows, edges = delta.flow_of(delta.over(t), found, keep)
        assert bag(rows.drop("owner")) == [r for r in bag(incidences(t)) if r[1] in ("S1", "M1")] and edges.count() == 3
        found = delta.touched(delta.over(t), wanted(dsar_id=["S1"]), keep)
        assert bag(found["runs"]) == [(0,)] and bag(found["aligned"]) == [("S1",)]


def test_a_change_reads_and_writes_touched_buckets_only(spark, tmp_path):
    docs = {"r": {}, "g": {}, "j": {}}
    for k in range(60):
        docs["r"] |= {f"run{k}": record(f"run{k}", MAKERS[0]), f"p{k}": record(f"p{k}", MAKERS[1], [f"run{k}"], dsar=f"M{k}")}
        docs["g"][f"M{k}"] = group(f"M{k}", MAKERS[1], [f"p{k}"])
    graphs = delta.StoredGraphs(spark, f"file://{tmp_path}/graphs", 16)
    graphs.build(built(spark, docs))
    every = [*graphs.tables.copies.values(), graphs.rows, graphs.edges, graphs.nodes, graphs.links]
    before = [table._snapshot(table._latest()) for table in every]
    read = []
    for table in every:
        table._rows = lambda held, only=None, of=table._rows: (read.append(len(held) if only is None else len(only)), of(held, only))[1]
    new = {"r": {"run7": record("run7", MAKERS[0], model="other")}, "g": {}, "j": {}}
    made = graphs.change(built(spark, new))
    assert made == {"aligned": 0, "runs": 0, "synced": 1, "nodes": 2} and max(read) <= 3
    for table, old in zip(every, before):
        now = table._snapshot(table._latest())
        assert sum(now.get(b) != old.get(b) for b in {*now, *old}) <= 2
    docs["r"] |= new["r"]
    del every, read
    assert stored(delta.StoredGraphs(spark, f"file://{tmp_path}/graphs", 16)) == whole(built(spark, docs))


def test_stored_links_do_not_grow_with_connectors(spark, tmp_path):
    """Twenty runs of a record with thirty parents have 600 connectors and 20 stored rows."""
    ends = [record(f"x{k}", MAKERS[0]) for k in range(30)]
    docs = {"r": {r["_id"]: r for r in [*ends, record("a", MAKERS[2], [f"x{k}" for k in range(30)]), *[record(f"j{k}", MAKERS[0], ["a"]) for k in range(20)]]}, "g": {}, "j": {}}
    graphs = delta.StoredGraphs(spark, f"file://{tmp_path}/graphs", 4)
    graphs.build(built(spark, docs))
    assert graphs.links.stubs().count() == 20 and bag(graphs.links.read()) == bag(model_graph.edges(built(spark, docs))) and graphs.links.read().count() == 600
