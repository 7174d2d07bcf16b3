"""Records of whole-document JSON files, read in many tasks.

A document is one array of objects (or one object), possibly on a single line. Every object ends in
``}``, so the files are read as text that is split at that character: no row is longer than the
text between two of them, and Spark splits the files among tasks as it does any text. Whether such
a ``}`` ends a record depends on everything before it: it may stand in a string, or in an inner object.

1. One pass gives a map per split: for a begin outside and inside a string, the state at its end and what it
   does to the depth of objects. (A depth never falls below zero, so its change is d -> max(d + a, b).)
2. The maps, one narrow row per split and at most ``MAX_SPLITS`` of them, are composed along each file.
3. A second pass, each split knowing its begin, cuts the records and accounts for all text between them:
   an opening bracket, commas, a closing bracket. Anything else (elements that are no objects, missing or
   doubled commas, a second value) is handed out as a reject. Pieces of records that go across splits
   are put together by split order.

Brackets within a record are left to the parser: a broken object ends at its own brace and spoils no other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewash.session import scratch_path, ship_package
from tablewash.sources.csv_records import FIRST, LATER, WHOLE, _runs

MAX_SPLITS = 1_000_000
UNENDED = "(no closing bracket)"
UTF8_MARK = b"\xef\xbb\xbf"

_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_OBJECT = re.compile(rb'(?:[^"{]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+(\{)', re.S)


def walk(text: bytes, inside: bool) -> tuple[bool, int]:
    """(whether a string is open at the end, opening braces outside strings)."""
    if inside:
        end = _REST.match(text)
        if not end:
            return True, 0
        text = text[end.end():]
    if b'"' not in text:
        return False, text.count(b"{")
    text = _STRING.sub(b"", text)
    at = text.find(b'"')
    return (False, text.count(b"{")) if at < 0 else (True, text.count(b"{", 0, at))


def _texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, block, size, line: the bytes up to each closing brace, in order within each split."""
    texts = spark.read.option("lineSep", "}").text(list(paths))
    return texts.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"),
    )


def _maps(batches):
    """Per split: bytes, first non-blank character, and for both begins the state and depth map (a, b) at the end."""
    names = ["file", "block", "size", "bytes", "first", "out_state", "out_a", "out_b", "in_state", "in_a", "in_b"]
    now, size, held, first = None, 0, 0, None
    ends: list[list] = []

    def row():
        values = (*now, size, held, first, *ends[0], *ends[1])
        return pa.record_batch([pa.array([v]) if n != "first" else pa.array([v], pa.string()) for n, v in zip(names, values)], names)

    for batch in batches:
        sizes = np.asarray(batch.column("size"))
        for file, block, a, b in _runs(batch):
            if (file, block) != now:
                if now:
                    yield row()
                # below zero braces: b stands for "no clamp yet"
                now, size, held, first, ends = (file, block), int(sizes[a]), 0, None, [[False, 0, -1 << 40], [True, 0, -1 << 40]]
            for text in batch.column("line").slice(a, b - a).to_pylist():
                held += len(text) + 1
                if first is None and (bare := text.removeprefix(UTF8_MARK).strip()):
                    first = chr(bare[0])
                for end in ends:
                    end[0], opened = walk(text, end[0])
                    close = 0 if end[0] else 1
                    end[1] += opened - close
                    end[2] = max(end[2] + opened - close, 0) if close else end[2] + opened
    if now:
        yield row()


_MAP_SCHEMA = "file string, block long, size long, bytes long, first string, out_state boolean, out_a long, out_b long, in_state boolean, in_a long, in_b long"


def begins(maps: list) -> dict:
    """(file, block) -> (inside, depth, array, start, last, open): the state that each split begins in, whether its
    file is an array, whether nothing but blanks came before, whether it is the file's last split and
    then ends without a closing brace."""
    known: dict = {}
    files: dict = {}
    for r in sorted(maps, key=lambda r: (r["file"], r["block"])):
        files.setdefault(r["file"], []).append(r)
    for file, rows in files.items():
        # text after the last brace: reading adds one byte to each row, also to that one
        unclosed = sum(r["bytes"] for r in rows) - rows[0]["size"] in (1, -2)
        first = next((r["first"] for r in rows if r["first"]), None)
        inside, depth, start = False, 0, True
        for r in rows:
            last = r is rows[-1]
            known[file, r["block"]] = (inside, depth, first == "[", start, last, last and unclosed)
            state, a, b = (r[f"{'in' if inside else 'out'}_{x}"] for x in ("state", "a", "b"))
            inside, depth, start = state, max(depth + a, b), start and not r["first"]
    return known


class _Cutter:
    """Cuts the texts of one split into records and rejects."""

    def __init__(self, state: tuple):
        self.inside, self.depth, self.array, self.start, self.last, self.unclosed = state
        self.held: list[bytes] | None = [] if self.depth else None
        self.begun = self.bad = False
        self.between = b""
        self.continued = self.inside and not self.depth  # an element that is no object came across the split's begin
        self.out: list[tuple] = []  # kind, bad, text

    def _account(self, text: bytes, end: bool) -> bool:
        """Whether the text between two records (or before the first, after the last) is in order; what isn't
        is a reject. False also if the next record is no element of the document's array."""
        text = text.strip()
        if self.continued:
            self.continued = False
            self.out.append((WHOLE, True, text.rstrip(b", \t\r\n") or text))
            return text.endswith(b"]" if end else b",")
        if not self.array:
            if text:
                self.out.append((WHOLE, True, text))
            return not text and (end or self.start)
        if end:
            if not text.endswith(b"]"):
                self.out.append((WHOLE, True, text or UNENDED.encode()))
                return False
            text = text[:-1].rstrip()
        opening = b"[" if self.start else b","
        if not text.startswith(opening):
            if not text and end and not self.start:
                return True
            self.out.append((WHOLE, True, text or b","))
            return False
        text = text[1:].lstrip()
        if end:
            if text or not self.start:
                self.out.append((WHOLE, True, text or b","))
            return not text
        if not text:
            return True
        self.out.append((WHOLE, True, text.rstrip(b", \t\r\n") or text))
        bare = _STRING.sub(b"", text)
        return text.endswith(b",") and bare.count(b"[") == bare.count(b"]")

    def add(self, text: bytes, closed: bool) -> None:
        """One text, followed by a brace if ``closed``."""
        if self.held is None:
            found = None if self.inside and not _REST.match(text) else _OBJECT.match(text, _REST.match(text).end() if self.inside else 0)
            if not found:
                self.inside, _ = walk(text, self.inside)
                self.between += text + (b"}" if closed else b"")
                if closed and not self.inside:  # a brace that closes nothing
                    self.out.append((WHOLE, True, self.between.strip()))
                    self.between, self.start, self.continued = b"", False, False
                return
            at = found.start(1)
            self.bad = not self._account(self.between + text[:at], False)
            self.between, self.inside, self.start = b"", False, False
            self.held, self.begun, text = [], True, text[at:]
        self.inside, opened = walk(text, self.inside)
        self.depth += opened
        self.held.append(text + (b"}" if closed else b""))
        if closed and not self.inside:
            self.depth -= 1
            if not self.depth:
                self.out.append((WHOLE if self.begun else LATER, self.bad, b"".join(self.held)))
                self.held, self.bad = None, False

    def finish(self) -> None:
        """At the split's end."""
        if self.held is not None:
            if self.held:
                self.out.append((FIRST if self.begun else LATER, self.bad, b"".join(self.held)))
        elif self.last:
            if self.between or self.array:
                self._account(self.between, True)
        elif self.between.strip():
            self.out.append((WHOLE, True, self.between.strip()))


def _cut(known):
    names = ["file", "block", "n", "kind", "bad", "record"]

    def run(batches):
        states = known.value
        now, cutter, n = None, None, 0
        waiting: bytes | None = None  # the split's latest text: only its last one may lack the brace

        def rows():
            nonlocal n
            found, cutter.out = cutter.out, []
            k = len(found)
            n += k
            kinds, bad, texts = zip(*found)
            return pa.record_batch(
                [pa.array([now[0]] * k), pa.array([now[1]] * k, pa.int64()), pa.array(range(n - k, n), pa.int64()), pa.array(kinds, pa.int32()), pa.array(bad), pa.array(texts, pa.binary())], names
            )

        def finished():
            cutter.add(waiting, not cutter.unclosed)
            cutter.finish()

        for batch in batches:
            for file, block, a, b in _runs(batch):
                if (file, block) != now:
                    if cutter:
                        finished()
                        if cutter.out:
                            yield rows()
                    now, n, waiting = (file, block), 0, None
                    cutter = _Cutter(states[now])
                for text in batch.column("line").slice(a, b - a).to_pylist():
                    if waiting is not None:
                        cutter.add(waiting, True)
                    elif cutter.start:
                        text = text.removeprefix(UTF8_MARK)
                    waiting = text
                if cutter.out:
                    yield rows()
        if cutter:
            finished()
            if cutter.out:
                yield rows()

    return run


def json_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """(file, block, n, record, bad): the text of every object of the documents, in file order by (file,
    block, n), and the rejects; stored once, as schema inference and every later job read it. None if the
    files make more than ``MAX_SPLITS`` splits."""
    ship_package(spark)
    texts = _texts(spark, paths)
    path = scratch_path(spark, "json-maps")
    texts.mapInArrow(_maps, _MAP_SCHEMA).write.parquet(path)
    maps = spark.read.schema(_MAP_SCHEMA).parquet(path)
    if maps.count() > MAX_SPLITS:
        return None
    shared = spark.sparkContext.broadcast(begins(maps.collect()))  # a row per split
    schema = "file string, block long, n long, kind int, bad boolean, record binary"
    path = scratch_path(spark, "json-records")
    texts.mapInArrow(_cut(shared), schema).write.option("compression", "zstd").parquet(path)
    cut = spark.read.schema(schema).parquet(path)
    whole = cut.where(F.col("kind") == WHOLE).select("file", "block", "n", F.col("record").cast("string").alias("record"), "bad")
    in_order = Window.partitionBy("file").orderBy("block", F.desc("kind"), "n").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cut.where(F.col("kind") != WHOLE).withColumn("r", F.sum((F.col("kind") == FIRST).cast("int")).over(in_order))
    joined = pieces.groupBy("file", "r").agg(F.min(F.struct("block", "n")).alias("at"), F.sort_array(F.collect_list(F.struct("block", "n", "record"))).alias("parts"), F.bool_or("bad").alias("bad"))
    text = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["record"])), "")).cast("string")
    return whole.unionByName(joined.select("file", F.col("at.block").alias("block"), F.col("at.n").alias("n"), text.alias("record"), "bad"))


def parse_records(spark: SparkSession, records: DataFrame, mode: str, schema=None, **options) -> DataFrame:
    """JSON texts (one column) as a table, its schema inferred from all of them unless given."""
    reader = spark.read.options(mode=mode, **options)
    if schema is not None:
        reader = reader.schema(schema)
    strings = getattr(records._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())  # noqa: SLF001
    return DataFrame(reader._jreader.json(strings), spark)  # noqa: SLF001
