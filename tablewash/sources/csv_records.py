"""Records of quoted CSV files, read in many tasks whatever stands in the quotes.

A line break within quotes belongs to a value, so a task that begins in the middle of a file can't tell
a record's end from a value's line break: that depends on everything before it. But a split can do only two
things to the reader's state at its lines' ends (between records, or inside a quoted value): it maps each of
the two to one of the two. So:

1. One pass over the lines gives each split's map, one narrow row per split.
2. The maps are composed along each file by window sums over those rows: a map is constant,
   or keeps the state, or swaps it; the state before a split is that of the last constant one, swapped
   as often as splits swapped since.
3. A second pass, each split now knowing its state, cuts lines into records. A record that goes on beyond its
   split leaves a piece in each split it touches; the pieces (at most two a split) are put together by
   split order.

Quotes are read as the CSV parser reads them: only a quote that begins a field opens a value, a doubled
quote within is one, and what follows a closing quote up to the separator belongs to the field. Lines
end in LF or CR LF; in a record that ends in CR LF its values' CR LF become LF, as the parser has it. The encoding must keep ASCII bytes as they are (UTF-8, ISO-8859-1, ...).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewash.session import ensure_checkpoint_dir, ship_package

# splits that may begin inside a quoted value (their places are broadcast); files.maxPartitionBytes
# sets the size of a split
MAX_OPEN_SPLITS = 1_000_000
# encodings whose line breaks and quotes are single bytes of their own (fixed values)
ASCII_LIKE = ("UTF-8", "US-ASCII", "ISO-8859-1", "ISO-8859-15", "WINDOWS-1252")
UTF8_MARK = b"\xef\xbb\xbf"

# records that end in their split, first and later pieces of those that don't
WHOLE, FIRST, LATER = 0, 1, 2
# place of a file's first record
HEAD = -1
_CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')  # pairs are never taken apart


def inside_after(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Whether a quoted value is open at the line's end, if one was (``inside``) at its begin."""
    at = 0
    while True:
        if inside or line.startswith(b'"', at):
            closing = _CLOSING.match(line, at if inside else at + 1)
            if not closing:
                return True
            at, inside = closing.end(), False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, block (where its split begins), line (bytes), in order within each split."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )


def _runs(batch: pa.RecordBatch):
    """(file, block, first row, end row) of the splits in a batch."""
    coded = batch.column("file").dictionary_encode()
    codes, blocks = np.asarray(coded.indices), np.asarray(batch.column("block"))
    change = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *change.tolist()], [*change.tolist(), len(codes)]):
        if b > a:
            yield coded.dictionary[int(codes[a])].as_py(), int(blocks[a]), a, b


def _maps(sep: bytes):
    """Each split's map: the state after it if it begins between records, and if it begins inside a value."""

    def run(batches):
        now, states, filled = None, [False, True], False
        empty = pa.array([b"", b"\r", UTF8_MARK, UTF8_MARK + b"\r"], pa.binary())

        def row():
            values = (*now, *states, filled)
            return pa.record_batch([pa.array([v]) for v in values], ["file", "block", "from_out", "from_in", "filled"])

        for batch in batches:
            lines = batch.column("line")
            quoted = np.flatnonzero(pc.match_substring(lines, '"'))  # a line without quotes keeps either state
            for file, block, a, b in _runs(batch):
                if (file, block) != now:
                    if now:
                        yield row()
                    now, states, filled = (file, block), [False, True], False
                filled = filled or not pc.all(pc.is_in(lines.slice(a, b - a), empty)).as_py()
                for i in quoted[np.searchsorted(quoted, a) : np.searchsorted(quoted, b)].tolist():
                    line = lines[i].as_py()
                    if block == 0 and i == a and line.startswith(UTF8_MARK):
                        line = line[len(UTF8_MARK):]
                    states = [inside_after(line, s, sep) for s in states] if states[0] != states[1] else [inside_after(line, states[0], sep)] * 2
        if now:
            yield row()

    return run


def open_splits(maps: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted value; ``maps``: a row per split."""
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("state"), F.col("swaps").alias("swaps")))
    counted = maps.withColumn("swaps", F.sum(swap).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("fixed", fixed)
    last = F.last("fixed", ignorenulls=True).over(before)
    passed = F.coalesce(F.lag("swaps").over(in_order), F.lit(0))
    state = (F.coalesce(last["state"], F.lit(0)) + passed - F.coalesce(last["swaps"], F.lit(0))) % 2
    return counted.select("file", "block", state.alias("state")).where("state = 1").select("file", "block")


def _cut(sep: bytes, known):
    """Lines -> file, block, n (place in the split; HEAD for a file's first record), kind, record."""
    names = ["file", "block", "n", "kind", "record"]

    def run(batches):
        opened, heads = known.value
        now, inside, n = None, False, 0
        held: list[bytes] = []  # lines of the record that is open
        begun = False  # in this split
        head = False  # the file's first record is still to come

        def rows(found: list[tuple]):
            k, kinds, records = zip(*found)
            return pa.record_batch(
                [pa.array([now[0]] * len(k)), pa.array([now[1]] * len(k), pa.int64()), pa.array(k, pa.int64()), pa.array(kinds, pa.int32()), pa.array(records, pa.binary())], names
            )

        for batch in batches:
            lines = batch.column("line")
            quoted = np.asarray(pc.match_substring(lines, '"'))
            for file, block, a, b in _runs(batch):
                if (file, block) != now:
                    if held:
                        yield rows([(HEAD if head else n, FIRST if begun else LATER, b"\n".join(held))])
                    now, n, held, begun = (file, block), 0, [], False
                    inside = now in opened
                    head = block == heads.get(file, 0)
                own = lines.slice(a, b - a)
                if not held and not inside and not quoted[a:b].any():
                    found = [(n + i, WHOLE, x.removeprefix(UTF8_MARK) if block == n + i == 0 else x) for i, x in enumerate(own.to_pylist())]
                    n += b - a
                else:
                    found = []
                    for x, q in zip(own.to_pylist(), quoted[a:b].tolist()):
                        if n == 0 and not held and block == 0 and x.startswith(UTF8_MARK):
                            x = x[len(UTF8_MARK):]
                        if not inside:
                            begun = True
                        held.append(x)
                        if q:
                            inside = inside_after(x, inside, sep)
                        if not inside:
                            found.append((n, WHOLE if begun else LATER, b"\n".join(held) if len(held) > 1 else x))
                            held, n = [], n + 1
                # empty lines between records are no records (a later piece may be one)
                found = [(k, kind, x[:-1].replace(b"\r\n", b"\n") if kind == WHOLE and x.endswith(b"\r") else x) for k, kind, x in found]
                found = [r for r in found if r[2] or r[1] != WHOLE]
                if found and head:
                    found[0], head = (HEAD, *found[0][1:]), False
                if found:
                    yield rows(found)
        if held:
            yield rows([(HEAD if head else n, FIRST if begun else LATER, b"\n".join(held))])

    return run


def plain_lines(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether every line of the files is a record as Spark's own line reader takes it: no quote, no CR,
    no blank line anywhere (one pass over the lines, without Python)."""
    v = F.col("value")
    odd = v.contains('"') | v.contains("\r") | v.rlike(r"^[\x00-\x20]*$")
    return not spark.read.option("lineSep", "\n").text(list(paths)).agg(F.bool_or(odd)).first()[0]


def csv_records(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """(file, block, n, record): every record's bytes, without its line break; file, block, n: its place
    (n is HEAD for the first record of a file, the header line).

    Two narrow passes decide where records begin (and are stored: a row per split, and the pieces of records
    that go across splits); the records themselves are cut lazily, each task streaming its splits."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    raw = sep.encode()
    lines = _lines(spark, paths)
    maps = lines.mapInArrow(_maps(raw), "file string, block long, from_out boolean, from_in boolean, filled boolean").checkpoint()
    begins = open_splits(maps)
    opened = begins.limit(MAX_OPEN_SPLITS + 1).collect()
    if len(opened) > MAX_OPEN_SPLITS:
        raise ValueError("too many splits begin inside quotes; raise spark.sql.files.maxPartitionBytes or read fewer files at once")
    # files whose first split holds empty lines only
    heads = maps.where("filled").groupBy("file").agg(F.min("block").alias("block")).where("block > 0").limit(MAX_OPEN_SPLITS).collect()
    shared = spark.sparkContext.broadcast(({(r["file"], r["block"]) for r in opened}, {r["file"]: r["block"] for r in heads}))
    cut = lines.mapInArrow(_cut(raw, shared), "file string, block long, n long, kind int, record binary")
    if not opened:
        # no split begins inside a value; only a file's last record can be open at its end
        return cut.select("file", "block", "n", "record")
    whole = cut.where(F.col("kind") == WHOLE).select("file", "block", "n", "record")
    pieces = cut.where(F.col("kind") != WHOLE).checkpoint()
    # a piece of an earlier record comes before the one that the split begins itself
    in_order = Window.partitionBy("file").orderBy("block", F.desc("kind"), "n").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("r", F.sum((F.col("kind") == FIRST).cast("int")).over(in_order))
    joined = pieces.groupBy("file", "r").agg(F.min(F.struct("block", "n")).alias("at"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.hex(p["record"])), "0A")
    joined = joined.select("file", F.col("at.block").alias("block"), F.col("at.n").alias("n"), text.alias("x"))
    # whole bytes in hexadecimal: a pair is never cut, as each line's end is one
    unified = F.regexp_replace(F.expr("left(x, length(x) - 2)"), "((?:[0-9A-F]{2})*?)0D0A", "$10A")
    record = F.unhex(F.when(F.endswith("x", F.lit("0D")), unified).otherwise(F.col("x")))
    return whole.unionByName(joined.select("file", "block", "n", record.alias("record")))
