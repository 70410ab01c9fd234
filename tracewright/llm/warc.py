"""WARC archives with a two-level capture index.

Writing: pages become WARC records, one gzip member each, in archive files in the shared folder.
Of records with equal payloads the one with the smallest page id is a response and the others are
revisits of it. Indexing: captures are sorted by their URL key, host reversed ("com,example)/path"),
and written as index shards of compressed blocks of lines; every shard ends with the sparse
directory of its blocks (first key, offset, length), and the shards' own first keys are a short
list, one row per shard. Reading: a key is found by binary search in the list, in the shard's
directory and in the block, each fetched by a range read; the record is a range read of its archive.

Files have names of their own for each attempt, and only those that a finished task names are read,
so a lost or repeated task leaves nothing behind that counts. Folders are URIs that pyarrow.fs
opens (file, s3, gs, hdfs, abfs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, table

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
CAPTURE = "key string, page_id long, url string, file string, offset long, length long"
SHARD = "first_key string, file string, at long, length long, n long"


def open_folder(uri: str):
    """(file system, path) of a folder's URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _local(uri: str) -> str:
    """file:/x, as Hadoop writes it, as file:///x."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def surt(url: Column | str = "url") -> Column:
    """The sort-friendly key of a URL: its host reversed, then path and query; null counts as empty."""
    text = F.regexp_replace(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), "#.*$", "")
    host = F.lower(F.regexp_extract(text, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_replace(rest, "\\s", "%20"))


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record, compressed. A revisit keeps the HTTP header of its page, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(SPACE, f"{page_id} {url}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> dict:
    """What a record says; a response's payload must have the digest that its header names."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the record of {fields['WARC-Target-URI']} is damaged")
    of = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {"page_id": int(of[0]) if of[0] else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(of[1]) if of[1] else None}


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with key, sha (hex), revisit and refers_to. Null html is empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "sha", "left")
    revisit = F.col("first").isNotNull() & (place != F.col("first"))
    key = F.concat(surt("url"), F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    return rows.select("page_id", "url", "html", "sha", key.alias("key"), F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 256_000_000) -> DataFrame:
    """Archives of pages in the folder; a row for each capture (CAPTURE)."""
    import pyarrow as pa

    folder = _local(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(f"{path}/archive", recursive=True)
                    name, at = f"archive/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                data = record(r["page_id"], r["url"], r["html"].encode(), digest, r["revisit"], r["refers_to"])
                out.write(data)
                rows.append((r["key"], r["page_id"], r["url"], name, at, len(data)))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
            yield _batch(rows, CAPTURE)
        if out is not None:
            out.close()

    return cut(decided(pages, min_bytes).mapInArrow(task, CAPTURE))


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields])


def index(captures: DataFrame, folder: str, block_lines: int = 3000) -> DataFrame:
    """The capture index in the folder; a row for each shard (SHARD), in no order. Keys are range-
    partitioned, so a host with most captures is many shards."""
    import pyarrow as pa

    folder = _local(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        out, name, at, blocks, lines, n = None, "", 0, [], [], 0

        def block() -> int:
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
            out.write(data)
            blocks.append((lines[0][0], at, len(data)))
            return len(data)

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(f"{path}/index", recursive=True)
                    name = f"index/{uuid.uuid4().hex}.cdx"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                lines.append([r["key"], r["page_id"], r["url"], r["file"], r["offset"], r["length"]])
                n += 1
                if len(lines) >= block_lines:
                    at += block()
                    lines = []
        if lines:
            at += block()
        if out is not None:
            directory = zlib.compress(json.dumps(blocks, ensure_ascii=False).encode(), 6)
            out.write(directory)
            out.close()
            yield _batch([(blocks[0][0], name, at, len(directory), n)], SHARD)

    ordered = captures.repartitionByRange("key").sortWithinPartitions("key")
    return cut(ordered.mapInArrow(task, SHARD))


class Index:
    """Look-ups in the capture index; keeps the last shard's directory and the last block."""

    def __init__(self, folder: str, shards: list[tuple]) -> None:
        """shards: (first_key, file, at, length) in the order of the keys."""
        self.fs, self.path = open_folder(_local(folder))
        self.shards, self.firsts = shards, [s[0].encode() for s in shards]
        self.directory, self.block, self.files = (-1, [], []), (None, [], []), {}

    def _range(self, name: str, at: int, length: int) -> bytes:
        if name not in self.files:
            for old in list(self.files)[:-7]:
                self.files.pop(old).close()
            self.files[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return self.files[name].read_at(length, at)

    def find(self, key: str) -> list[list]:
        """All captures of a key: [key, page_id, url, file, offset, length]."""
        sought, out = key.encode(), []
        # a key's captures may begin in the shard, and the block, before the last that begins with it
        for s in range(max(0, bisect_left(self.firsts, sought) - 1), bisect_right(self.firsts, sought)):
            if self.directory[0] != s:
                _, name, at, length = self.shards[s]
                blocks = json.loads(zlib.decompress(self._range(name, at, length)))
                self.directory = (s, blocks, [b[0].encode() for b in blocks])
            _, blocks, firsts = self.directory
            for b in range(max(0, bisect_left(firsts, sought) - 1), bisect_right(firsts, sought)):
                if self.block[0] != (s, b):
                    text = zlib.decompress(self._range(self.shards[s][1], *blocks[b][1:])).decode()
                    lines = [json.loads(x) for x in text.split("\n")]
                    self.block = ((s, b), lines, [x[0].encode() for x in lines])
                _, lines, keys = self.block
                out += lines[bisect_left(keys, sought) : bisect_right(keys, sought)]
        return out

    def read(self, capture: list) -> dict:
        """The record of a capture."""
        return parse(self._range(*capture[3:6]))


def shard_list(shards: DataFrame) -> list[tuple]:
    """The shards in order: a row for each partition of the sort, however many captures there are."""
    return [tuple(r) for r in shards.orderBy("first_key").select("first_key", "file", "at", "length").collect()]


def look_up(keys: DataFrame, folder: str, shards: list[tuple]) -> DataFrame:
    """keys(key) to the captures (CAPTURE) of each distinct key. Keys are asked for in order, so
    that neighbours share a block."""
    import pyarrow as pa

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(folder, shards)
        for batch in batches:
            yield _batch([tuple(x) for key in batch.column(0).to_pylist() for x in known.find(key)], CAPTURE)

    ordered = keys.select("key").where("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(task, CAPTURE)


def read_records(captures: DataFrame, folder: str, chunk_bytes: int = 8_000_000) -> DataFrame:
    """The records of captures by range reads, neighbours of an archive in one task and in order.
    Tasks go by the bytes to read, not by the size of the captures' own rows."""
    import pyarrow as pa

    made = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in made.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Index(folder, [])
        for batch in batches:
            found = (archive.read([None, None, None, r["file"], r["offset"], r["length"]]) for r in batch.to_pylist())
            yield _batch([tuple(x[n] for n in names) for x in found], made)

    captures = cut(captures)
    size = captures.agg(F.sum("length")).first()[0] or 0
    chunk = F.floor(F.col("offset") / chunk_bytes)
    dealt = captures.select("file", "offset", "length").repartition(-(-size // chunk_bytes) or 1, "file", chunk).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(task, made)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives and index, then reads every page's record back by its key: one
    row per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is the empty payload; payloads of fewer than min_bytes bytes never revisit; a null
    url has the key of the empty URL; a null page_id comes last among equal payloads. Of rows with
    equal payload and page_id the one with the least url is the response; rows equal in everything
    are responses alike, each with a record. A payload is written and read whole at any length.
    Extra columns are not read. An empty table gives no rows."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    captures = write(pages, folder, min_bytes)
    shards = shard_list(index(captures, folder))
    return read_records(look_up(captures.select("key"), folder, shards), folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


#: A digest's 40 hex digits are eight groups of 20 bits, each four base32 digits.
ORACLE = """
WITH page AS (SELECT page_id::BIGINT AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS sha FROM page),
placed AS (SELECT *, first_value(page_id) OVER w AS first_id, first_value(url) OVER w AS first_url FROM hashed
  WINDOW w AS (PARTITION BY sha ORDER BY page_id NULLS LAST, url ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
told AS (SELECT *, page_id IS DISTINCT FROM first_id OR url <> first_url AS revisit FROM placed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha, 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first_id END AS refers_to
FROM told
"""
