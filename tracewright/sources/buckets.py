"""A table that is written in place of the store's collections: hash buckets and snapshots.

A table is a folder. Rows lie in Parquet folders, one for each bucket of their keys' hash; a snapshot
is a small file that names the folder of every bucket, so it lists buckets, never rows. A write makes
new folders for the buckets it touches and then a snapshot with the next number; the others stay as
they are and are not read. The snapshot's file is written whole under a name of its own and renamed
to its number only if no one has that number: of two writers at once one wins and the other starts
again from what it finds, and a writer that dies on its way leaves folders that no snapshot names.
Readers take the latest snapshot, so they see a write as a whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written
from . import store


class Conflict(Exception):
    """Another writer was first, again and again."""


class BucketTable:
    """keys name a row; seq tells which of several rows of a key is the last. No row is a key's own
    until it is upserted: insert keeps repeats, as an append does."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], n_buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.n_buckets = spark, path.rstrip("/"), schema, keys, n_buckets
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ snapshots

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _latest(self) -> int:
        """The number of the last snapshot, -1 before the first."""
        if not self._fs.exists(self._at("snapshots")):
            return -1
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("snapshots"))]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=-1)

    def _snapshot(self, number: int) -> dict[int, list[str]]:
        """The folders of each bucket that has rows."""
        if number < 0:
            return {}
        stream = self._fs.open(self._at(f"snapshots/{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        if held["n_buckets"] != self.n_buckets or held["keys"] != self.keys:
            raise ValueError(f"the table has {held['n_buckets']} buckets by {held['keys']}")
        return {int(b): folders for b, folders in held["buckets"].items()}

    def _publish(self, number: int, buckets: dict[int, list[str]]) -> bool:
        """Whether the snapshot came to be; False if another writer has the number."""
        text = json.dumps({"n_buckets": self.n_buckets, "keys": self.keys, "buckets": {str(b): f for b, f in sorted(buckets.items())}})
        draft, final = self._at(f"snapshots/draft-{uuid.uuid4().hex}"), self._at(f"snapshots/{number:012d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options
        none = self.spark._sc._gateway.new_array(options.Rename, 1)
        none[0] = options.Rename.NONE  # never over a file that is there
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, none)
        except Exception as error:
            if self._fs.exists(final):
                self._fs.delete(draft, False)
                return False
            raise error
        return True

    # ------------------------------------------------------------ reads

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def _rows(self, buckets: dict[int, list[str]], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}" for b, folders in sorted(buckets.items()) if only is None or b in only for f in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return written(self.spark, self.schema, *paths)

    def read(self, snapshot: int | None = None) -> DataFrame:
        """The rows as the last write, or the write of that number, left them."""
        return self._rows(self._snapshot(self._latest() if snapshot is None else snapshot))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys, from their buckets alone. wanted should be few keys."""
        held = self._snapshot(self._latest())
        touched = {r["b"] for r in wanted.select(self.bucket().alias("b")).distinct().collect()}  # n_buckets at most
        return self._rows(held, touched).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    # ------------------------------------------------------------ writes

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Writes rows by bucket; the new folder of each bucket that has some."""
        name = f"data/{uuid.uuid4().hex}"
        # rebalanced, not repartitioned: a bucket with a hot key is divided among tasks and has several files
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._at(name)) if f.isDirectory()]
        return {int(f.partition("=")[2]): f"{name}/{f}" for f in found}

    def _commit(self, change: Callable[[dict[int, list[str]]], dict[int, list[str]]], tries: int = 20) -> int:
        for _ in range(tries):
            number = self._latest()
            if self._publish(number + 1, change(self._snapshot(number))):
                return number + 1
        raise Conflict(f"{tries} other writers were first")

    def insert(self, rows: DataFrame) -> int:
        """Adds rows as they are; none of the old ones is read. Returns the snapshot's number."""
        new = self._write(rows.select(*self._columns()))
        return self._commit(lambda held: held | {b: [*held.get(b, []), f] for b, f in new.items()})

    def upsert(self, rows: DataFrame, seq: str) -> int:
        """Puts each row in place of its key's; of several the one with the greatest seq stays, the
        old ones' seq counted. Reads and rewrites the buckets of the rows' keys only."""
        return self._merge(rows, lambda old, new: store.upsert(old.unionByName(new), self.keys, seq).select(*self._columns()))

    def push(self, rows: DataFrame, name: str) -> int:
        """Adds the rows' lists to the end of their keys' lists; other fields are the rows' own (the
        greatest value of each where rows of a key differ). Touches the rows' buckets only."""
        others = [c for c in self._columns() if c not in (*self.keys, name)]

        def joined(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            parts = both.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct("_new", name))).alias("_l"), *[F.max_by(c, F.struct("_new", c)).alias(c) for c in others])
            return parts.withColumn(name, F.flatten(F.col(f"_l.{name}"))).select(*self._columns())

        return self._merge(rows, joined)

    def set_field(self, wanted: DataFrame, name: str, value: Column) -> int:
        """Sets one field of the rows with the wanted keys; their buckets only are touched."""
        keys = wanted.select(*self.keys).distinct()

        def changed(old: DataFrame, _: DataFrame) -> DataFrame:
            marked = old.join(keys.withColumn("_hit", F.lit(True)), self.keys, "left")
            return marked.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)).cast(old.schema[name].dataType)).select(*self._columns())

        return self._merge(wanted, changed)

    def replace(self, gone: DataFrame, rows: DataFrame, on: list[str] | None = None) -> int:
        """Takes out the rows that agree with one of gone in the columns ``on`` (the keys, or the keys
        and more) and adds rows, in one snapshot. Touches the buckets of gone and rows only; both are
        read several times and should be cut."""
        on = on or self.keys
        out = gone.select(*on).distinct()
        where = out.select(*self.keys).unionByName(rows.select(*self.keys))
        return self._merge(where, lambda old, _: old.join(out, on, "left_anti").unionByName(rows.select(*self._columns())))

    def truncate(self) -> int:
        """A snapshot without rows; earlier ones can still be read by number."""
        return self._commit(lambda _: {})

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _merge(self, rows: DataFrame, of: Callable[[DataFrame, DataFrame], DataFrame], tries: int = 20) -> int:
        touched = {r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # n_buckets at most
        new = rows.select(*self._columns()) if set(self._columns()) <= set(rows.columns) else rows
        for _ in range(tries):
            number = self._latest()
            held = self._snapshot(number)
            made = self._write(of(self._rows(held, touched), new))
            rest = {b: f for b, f in held.items() if b not in touched}
            if self._publish(number + 1, rest | {b: [f] for b, f in made.items()}):
                return number + 1
        raise Conflict(f"{tries} other writers were first")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last ``keep`` snapshots names, and the older
        snapshots; how many folders went. Not while someone writes or reads an older snapshot."""
        last = self._latest()
        named = {f.rpartition("/")[0] for n in range(max(0, last - keep + 1), last + 1) for folders in self._snapshot(n).values() for f in folders}
        gone = 0
        if self._fs.exists(self._at("data")):
            for f in self._fs.listStatus(self._at("data")):
                if f"data/{f.getPath().getName()}" not in named:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        for f in self._fs.listStatus(self._at("snapshots")) if last >= 0 else []:
            name = f.getPath().getName().removesuffix(".json")
            if not name.isdigit() or int(name) <= last - keep:
                self._fs.delete(f.getPath(), False)
        return gone
