"""Stored writes: snapshots, touched buckets, two writers, a killed one."""

import threading

import pytest
from pyspark.sql import functions as F

from tracewright.sources.buckets import BucketTable

SCHEMA = "k string, seq int, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], n_buckets=8)


def test_writes(spark, table):
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    assert rows(table.read()) == []
    table.insert(make([("a", 0, "x"), ("b", 0, "y"), ("a", 0, "x")]))
    assert rows(table.read()) == [("a", 0, "x"), ("a", 0, "x"), ("b", 0, "y")]
    table.upsert(make([("a", 2, "new"), ("c", 1, "z"), ("a", 1, "late")]), "seq")
    assert rows(table.read()) == [("a", 2, "new"), ("b", 0, "y"), ("c", 1, "z")]
    table.upsert(make([("a", 1, "older")]), "seq")
    assert ("a", 2, "new") in rows(table.read())
    number = table.set_field(make([("b", 0, "")]), "v", F.concat("v", F.lit("!")))
    assert rows(table.lookup(make([("b", 0, ""), ("zzz", 0, "")]))) == [("b", 0, "y!")]
    table.truncate()
    assert rows(table.read()) == [] and ("b", 0, "y!") in rows(table.read(number))
    with pytest.raises(ValueError, match="8 buckets"):
        BucketTable(spark, table.path, SCHEMA, ["k"], n_buckets=4).upsert(make([("a", 1, "x")]), "seq")


def test_only_touched_buckets_are_read_and_written(spark, table):
    data = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("seq"), F.lit("x").alias("v"))
    before = table._snapshot(table.insert(data))
    after = table._snapshot(table.upsert(spark.createDataFrame([("7", 1, "seven")], SCHEMA), "seq"))
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    found = table.lookup(spark.createDataFrame([("7", 0, "")], SCHEMA))
    assert len(found.inputFiles()) >= 1 and {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles() if "_bucket=" in f} == {str(b) for b in before if before[b] != after[b]}
    assert table.read().count() == 200 and table.vacuum() >= 0 and table.read().count() == 200


def test_push(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/p", "k string, kind string, l array<string>", ["k"], 4)
    make = lambda data: spark.createDataFrame(data, table.schema)
    table.push(make([("a", "x", ["e1"]), ("b", "x", ["e2"])]), "l")
    table.push(make([("a", "y", ["e1", "e0"])]), "l")
    assert rows(table.read()) == [("a", "y", ["e1", "e1", "e0"]), ("b", "x", ["e2"])]


def test_two_writers_and_a_killed_one(spark, table):
    errors = []

    def writer(name):
        try:
            for k in range(3):
                table.upsert(spark.createDataFrame([(f"{name}{k}", k, name), ("shared", k, name)], SCHEMA), "seq")
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=writer, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and table._latest() == 5
    found = rows(table.read())
    assert [r for r in found if r[0] != "shared"] == sorted((f"{n}{k}", k, n) for n in "ab" for k in range(3))
    assert [r[1] for r in found if r[0] == "shared"] == [2]

    class Killed(Exception):
        pass

    def dies(*_):
        raise Killed

    publish, table._publish = table._publish, dies
    with pytest.raises(Killed):  # its folders are written, its snapshot is not
        table.upsert(spark.createDataFrame([("lost", 9, "x"), ("shared", 9, "x")], SCHEMA), "seq")
    table._publish = publish
    assert rows(table.read()) == found
    assert table.vacuum() > 0 and rows(table.read()) == found
