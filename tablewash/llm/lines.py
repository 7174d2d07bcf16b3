"""Line dedup: windows of lines matched by content hash after a winnowing filter, later runs deleted.

A text is its sequence of lines; blank ones take no part in matching. A window starts at
any line and ends where it first holds ``min_words`` words, so every run of lines that two
places share and that holds as many words contains a window whole. Each window selects its
least line hash (the rightmost, if equal) as its fingerprint; a shared window therefore
selects the same line in both places.

1. Every window is written with its fingerprint and the hash of its content. Fingerprints
   are counted by window; windows of those that occur once in the corpus are done with.
2. Windows of the others are counted by their content hash, which alone tells them
   apart; the place with the least (doc_id, line) is first.
3. Every later window is deleted, and with it all runs that such windows make up together.
   A window overlapping the first place itself (in the same document) is kept.

So a line goes if and only if it lies in a window that occurred earlier. Blank lines go
with the lines on both sides of them. A first place, of the least document, stays.

Results: NULL texts stay NULL, empty and blank ones stay as they are; rows of equal
doc_id and text are one document (all keep the same lines); NULL ids come first, and of
rows of one id the one with the least text hash; an empty table gives no rows; a very long text is taken whole; all columns of ``docs`` are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.functions.names import c
from tablewash.llm.common import prepare, stored

#: Words of the shortest run that is deleted.
MIN_WORDS = 30


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def windows(lines: list[str], min_words: int) -> list[tuple[int, int, int, int]]:
    """(fingerprint, window key, first line, last line) of each window; line numbers count all lines."""
    own = [(i, n) for i, x in enumerate(lines) if (n := len(x.split()))]
    hashes = [line_hash(lines[i]) for i, _ in own]
    out = []
    end = words = 0
    best: list[int] = []  # increasing hashes: the sliding minimum
    head = 0
    for start in range(len(own)):
        while end < len(own) and words < min_words:
            words += own[end][1]
            while len(best) > head and hashes[best[-1]] >= hashes[end]:
                best.pop()
            best.append(end)
            end += 1
        if words < min_words:
            break
        while best[head] < start:
            head += 1
        key = hashes[start] if end == start + 1 else line_hash(",".join(map(str, hashes[start:end])))
        out.append((hashes[best[head]], key, own[start][0], own[end - 1][0]))
        words -= own[start][1]
    return out


def _places(docs: DataFrame, min_words: int) -> DataFrame:
    """Every window with its document (id, text hash) and fingerprint."""
    names = ["id", "h", "mark", "key", "start", "stop"]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, h, text in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), batch.column("text")):
                for w in windows((text.as_py() or "").split("\n"), min_words):
                    for col, v in zip(cols, (i, h, *w)):
                        col.append(v)
                if len(cols[0]) > 1 << 16:
                    yield batch_of(cols)
                    cols = [[] for _ in names]
            yield batch_of(cols)

    def batch_of(cols):
        return pa.record_batch([pa.array(x, pa.int64()) for x in cols], names)

    return docs.select("id", "h", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def repeated(spark: SparkSession, docs: DataFrame, min_words: int) -> DataFrame:
    """``id``, ``h``, ``ranges`` (array of (start, stop) lines) to delete; ``docs``: id, h, text."""
    found = stored(spark, _places(docs, min_words), "line-windows")
    marks = found.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    # windows around the places of repeated fingerprints, keyed by their content
    near = found.join(marks, "mark", "left_semi").select("key", "id", "h", "start", "stop")
    first = near.groupBy("key").agg(F.min(F.struct("id", "h", "start", "stop")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = near.join(first, "key").where("id != first.id or h != first.h or start > first.stop")
    return later.groupBy("id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def dedup_lines(
    spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", counts: tuple[str, str] = ("n_lines", "n_deleted")
) -> DataFrame:
    """All columns of ``docs`` with the later repeated runs taken out of ``text``, and two added
    columns named by ``counts`` (lines before, lines taken out); columns of those names are replaced."""
    prepare(spark)
    whole = c(text).cast("string")
    names = [x for x in docs.columns if x not in counts]
    # plain names inside: the caller's names can't clash, nor a dot in them mislead
    inner = [f"x{i}" for i in range(len(names))]
    place = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "h": F.xxhash64(whole)}
    plain = docs.select(place["id"].alias("id"), place["h"].alias("h"), whole.alias("text")).where("text is not null")
    ranges = repeated(spark, plain, min_words).select("id", "h", "ranges")

    def run(batches):
        for batch in batches:
            texts, before, gone = [], [], []
            for x, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                lines = [] if x is None else x.split("\n")
                drop = np.zeros(len(lines), bool)
                for y in r or ():
                    drop[y["start"] : y["stop"] + 1] = True
                texts.append(x if not drop.any() else "\n".join([t for t, d in zip(lines, drop.tolist()) if not d]))
                before.append(len(lines))
                gone.append(int(drop.sum()))
            cols = [pa.array(texts, pa.string()) if y == text else batch.column(x) for x, y in zip(inner, names)]
            yield pa.record_batch([*cols, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*inner, "before", "gone"])

    kept = {x: y for x, y in zip(inner, names) if y != text}
    own = docs.select(*(c(y).alias(x) for x, y in kept.items()), whole.alias("text"), *(x.alias(n) for n, x in place.items()))
    joined = own.join(ranges, ["id", "h"], "left").select(*kept, "text", "ranges")
    fields = ", ".join(f"{x} {'string' if y == text else docs.schema[y].dataType.simpleString()}" for x, y in zip(inner, names))
    return joined.mapInArrow(run, f"{fields}, before long, gone long").toDF(*names, *counts)
