"""WARC archives with a two-level capture index.

Writing: every task streams its pages into archive files of its own (one gzip member per
record, a new file after ``ROLL`` bytes) in the shared folder and gives Spark the place of
each record. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is
a response; the others are revisits that refer to it and repeat no payload.

Index: places are range-partitioned and sorted by (reversed-host URL key, page id); each
partition becomes one shard file of compressed blocks of ``BLOCK`` lines and a sparse directory that
holds each block's first key. The list of shards with their first keys has one entry per task.

Reading: keys are sorted likewise; a task finds the shard, then the block by binary search in the
shard's directory, range-reads and unpacks that block (the last ones stay at hand), searches it, and
range-reads the record from its archive.

A task that is lost runs again under new file names; only files named in the rows that Spark
kept are ever read. Files go through pyarrow's file systems, so the folder may be local, HDFS or
an object store.

Results: NULL html is an empty payload; NULL or odd URLs get the key of their text without a host;
a URL that a third of all pages share spreads over shards (the page id is part of the key); rows of one
page id are records of their own, and reading gives a row for each that has its URL and id;
NULL ids are records without references (each a response); other columns are ignored; an empty table gives
no rows. A record is held whole in memory, a block or directory too, a table never.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from base64 import b32encode
from collections import OrderedDict

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewash.llm.common import prepare, stored
from tablewash.session import scratch_path

ROLL = 1 << 30
BLOCK = 256
#: Captures of one shard.
SHARD = 1 << 20
NO_ID = -(1 << 63)
DATE = "2026-01-01T00:00:00Z"  # captures carry no time


def surt(url: Column) -> Column:
    """Sort key: host parts reversed, then path and query, without scheme and fragment."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)"
    host = F.lower(F.regexp_extract(whole, pattern, 1))
    rest = F.regexp_extract(whole, pattern, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.when(host == "", F.concat(F.lit(")"), whole)).otherwise(key)


def records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, url, html, key, id, refers_to``: refers_to is NULL for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    # one narrow row per payload that several pages have: copies are summed up before the shuffle
    last = own.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("other"))
    last = last.where("last != other").select("digest", "last")
    joined = own.join(last, "digest", "left")
    refers = F.when(F.col("last") != F.col("page_id"), F.col("last"))
    return joined.select("page_id", "url", "html", surt(F.col("url")).alias("key"), F.coalesce("page_id", F.lit(NO_ID)).alias("id"), refers.alias("refers_to"))


def digest_of(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record_of(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record."""
    payload = html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (the HTTP body) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives; ``key, id, file, at, size`` of every record (stored in the shared folder)."""
    prepare(spark)
    names = ["key", "id", "file", "at", "size"]

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = file = None
        at = 0
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{file}", compression=None)
                data = gzip.compress(record_of(r["page_id"], r["url"], r["html"], r["refers_to"]), 6, mtime=0)
                out.write(data)
                for c, v in zip(cols, (r["key"], r["id"], file, at, len(data))):
                    c.append(v)
                at += len(data)
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names)
        if out is not None:
            out.close()

    return stored(spark, records(pages, min_bytes).mapInArrow(run, "key string, id long, file string, at long, size long"), "warc-places")


def build_index(spark: SparkSession, places: DataFrame, folder: str) -> list[dict]:
    """Write the shards; the list of shards (first key and id, files), one per task, sorted."""
    tasks = max(1, -(-places.count() // SHARD))
    dealt = places.repartitionByRange(tasks, "key", "id").sortWithinPartitions("key", "id", "file", "at")

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        directory: list = []
        block: list = []
        out, at = None, 0

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(map(json.dumps, block)).encode())
            out.write(data)
            directory.append((*block[0][:2], at, len(data)))
            at += len(data)
            block.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "file", "at", "size"))):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.blocks", compression=None)
                block.append(row)
                if len(block) == BLOCK:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.record_batch([pa.array([x]) for x in (directory[0][0], directory[0][1], name)], ["key", "id", "name"])

    found = stored(spark, dealt.mapInArrow(run, "key string, id long, name string"), "warc-shards")
    return sorted(({**r.asDict()} for r in found.collect()), key=lambda r: (r["key"].encode(), r["id"]))  # one row per task


class Index:
    """Binary search in the shards; the latest blocks, directories and archives stay open."""

    def __init__(self, shards: list[dict], index: str, archives: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(index)
        self.archive_fs, self.archive_root = pa.fs.FileSystem.from_uri(archives)
        self.shards, self.first = shards, [(r["key"].encode(), r["id"]) for r in shards]
        self.kept: OrderedDict = OrderedDict()

    def _keep(self, key, make, most: int = 64):
        if key not in self.kept:
            self.kept[key] = make()
            if len(self.kept) > most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]

    def _directory(self, name: str):
        def make():
            with self.fs.open_input_file(f"{self.root}/{name}.directory") as f:
                rows = json.loads(zlib.decompress(f.read()))
            return [(k.encode(), i) for k, i, _, _ in rows], rows

        return self._keep(("directory", name), make)

    def _block(self, name: str, number: int):
        def make():
            _, _, at, size = self._directory(name)[1][number]
            f = self._keep(("blocks", name), lambda: self.fs.open_input_file(f"{self.root}/{name}.blocks"))
            rows = [json.loads(x) for x in zlib.decompress(f.read_at(size, at)).split(b"\n")]
            return [(r[0].encode(), r[1]) for r in rows], rows

        return self._keep(("block", name, number), make)

    def find(self, key: str, low: int = NO_ID, high: int = (1 << 63) - 1):
        """Captures [key, id, file, at, size] of the key with ids from ``low`` to ``high``."""
        want, stop = (key.encode(), low), (key.encode(), high)
        shard = max(bisect.bisect_left(self.first, want) - 1, 0)
        while shard < len(self.shards) and self.first[shard] <= stop:
            name = self.shards[shard]["name"]
            firsts, _ = self._directory(name)
            number = max(bisect.bisect_left(firsts, want) - 1, 0)
            while number < len(firsts) and firsts[number] <= stop:
                keys, rows = self._block(name, number)
                yield from rows[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, stop)]
                number += 1
            shard += 1

    def read(self, capture) -> tuple[dict[str, str], bytes]:
        _, _, file, at, size = capture
        f = self._keep(("archive", file), lambda: self.archive_fs.open_input_file(f"{self.archive_root}/{file}"))
        return parse(gzip.decompress(f.read_at(size, at)))


def _lookup(spark: SparkSession, asked: DataFrame, shards: list[dict], index: str, archives: str, columns: str, row_of) -> DataFrame:
    """``asked``: distinct (key, low, high); one row per capture found."""
    prepare(spark)
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in columns.split(", ")])

    def run(batches):
        own = Index(shards, index, archives)
        for batch in batches:
            rows = []
            for key, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high"))):
                for capture in own.find(key, low, high):
                    rows.append(row_of(capture, *own.read(capture)))
                    if len(rows) >= 1024:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, spark.sparkContext.defaultParallelism * 2, -(-asked.count() // SHARD))
    return asked.repartitionByRange(tasks, "key", "low").sortWithinPartitions("key", "low").mapInArrow(run, columns)


def captures(spark: SparkSession, urls: DataFrame, shards: list[dict], index: str, archives: str) -> DataFrame:
    """All captures of the given URLs (column ``url``): key, page_id, record_type, payload_digest, refers_to, html
    (NULL for revisits)."""
    asked = urls.select(surt(F.col("url").cast("string")).alias("key")).distinct().select("key", F.lit(NO_ID).alias("low"), F.lit((1 << 63) - 1).alias("high"))

    def row_of(capture, fields, payload):
        response = fields["WARC-Type"] == "response"
        return _row(capture, fields, payload) | {"html": payload if response else None}

    return _lookup(spark, asked, shards, index, archives, "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary", row_of)


def _row(capture, fields: dict[str, str], payload: bytes) -> dict:
    response = fields["WARC-Type"] == "response"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and digest_of(payload) != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return {
        "key": capture[0],
        "page_id": None if capture[1] == NO_ID else capture[1],
        "payload_bytes": len(payload) if response else None,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else int(fields["WARC-Refers-To"][len("<urn:page:") : -1]),
    }


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, index them, and read every page back through the index. A revisit's
    payload length is that of the record it refers to."""
    prepare(spark)
    folder = scratch_path(spark, "warc")
    places = write_archives(spark, pages, f"{folder}/archives", min_bytes)
    shards = build_index(spark, places, f"{folder}/index")
    asked = pages.select(surt(F.col("url").cast("string")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("low"))
    asked = asked.distinct().withColumn("high", F.col("low"))
    columns = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    read = stored(spark, _lookup(spark, asked, shards, f"{folder}/index", f"{folder}/archives", columns, _row), "warc-read")
    full = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("target")).agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = read.where("record_type = 'revisit'").join(full, F.col("refers_to") == F.col("target"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(*names).union(revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), *names[2:]))
