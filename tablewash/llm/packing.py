"""Lexical retrieval packing: token sequences of one window each, filled with BM25 neighbours.

1. Every text is tokenized (plus an end id) and cut: whole windows are sequences
   already; what is left of each document, under one window, is its tail.
2. Tails are range-partitioned by a lexical sketch (the ``LEAST`` least hashes of their
   ids, in order) and the document id, so alike tails meet and a sketch that a third of
   all rows share still spreads. Partitions follow the number of tokens.
3. The BM25 statistics (tails, their mean length, tails that hold a term) are counted over
   all tails once and broadcast; the vocabulary bounds them.
4. A partition goes through its tails in shards of ``SHARD`` documents. Each shard
   has an inverted index with BM25 weights; the next unused tail is the seed, its
   neighbours come in order of score, those that fit fill the window, and when
   none fits the best one is cut to fill it exactly (its rest stays in the shard).
   What the last shard leaves is cut into powers of two. So no sequence is padded.

Neighbours come from the shard alone: beyond ``SHARD`` tails most of a seed's nearest ones are
in other shards (README gives the recall).

Results: a NULL or empty text is its end id alone; repeated rows and NULL ids are
packed row by row; an empty table gives no rows; other columns are ignored; a very
long text is tokenized whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.llm.common import mix, prepare, slices, stored
from tablewash.llm.encoding import encoder_of

WINDOW = 2048
END_ID = 1
#: Tails of one inverted index.
SHARD = 512
#: Least hashes in a tail's sketch.
LEAST = 4
#: Tail tokens of one task.
TASK_TOKENS = 1 << 22
K1, B = 1.2, 0.75


def tails(docs: DataFrame, path: str, window: int, with_ids: bool) -> DataFrame:
    """Pieces of whole windows (``ids`` only on demand) and tails (with ids and sketch) of all documents."""

    def run(batches):
        own = encoder_of(path, True, None)
        salt = mix(np.arange(own.merger.size, dtype=np.uint64) + np.uint64(0x51ED27))
        wide = np.dtype("<u2") if own.merger.size <= 1 << 16 else np.dtype("<u4")
        end = np.uint32(END_ID).tobytes()
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in slices(texts):
                who, start, length, crc, total, tail, sketch = [], [], [], [], [], [], []
                for i, raw in enumerate(own.encode(texts[a:b]), a):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, window):
                        piece = raw[4 * at : 4 * (at + window)]
                        whole = len(piece) == 4 * window
                        ids = np.frombuffer(piece, "<u4")
                        who.append(i)
                        start.append(at)
                        length.append(len(ids))
                        crc.append(zlib.crc32(piece) if whole else None)
                        total.append(n)
                        tail.append(None if whole and not with_ids else ids.astype(wide).tobytes())
                        sketch.append(None if whole else np.unique(salt[ids])[:LEAST].astype(">u8").tobytes())
                yield pa.record_batch(
                    [names.take(pa.array(who, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(tail, pa.large_binary()), pa.array(sketch, pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sketch binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Statistics:
    """Of a set of tails: how many, their mean length, and by term how many hold it."""

    def __init__(self, count: int, tokens: int, holders: np.ndarray):
        self.count, self.tokens, self.mean, self.holders = count, tokens, tokens / max(count, 1), holders


def holding(texts: list[np.ndarray]) -> np.ndarray:
    """By term: the texts that hold it."""
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(np.unique(own * (1 << 32) + np.concatenate(texts).astype(np.int64)) & 0xFFFFFFFF)


def statistics(cut: DataFrame) -> Statistics:
    """Of all tails: one row per term of each task, summed in Spark."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            texts = [np.frombuffer(x, wide_of(len(x), n)) for x, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())]
            for at in range(0, len(texts), SHARD):
                own = holding(texts[at : at + SHARD])
                total = np.pad(total, (0, max(len(own) - len(total), 0)))
                total[: len(own)] += own
        terms = np.flatnonzero(total)
        yield pa.record_batch([pa.array(terms), pa.array(total[terms])], ["term", "n"])

    own = cut.where("sketch is not null").select("ids", "length")
    count, tokens = own.agg(F.count("*"), F.sum("length")).first()
    rows = own.select("ids", "length").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    holders = np.zeros(max((r.term for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        holders[r.term] = r.n
    return Statistics(count, tokens or 0, holders)


class Shard:
    """Tails with an inverted index: BM25 weight of each (term, document), by the statistics of
    all tails (without them, of these)."""

    def __init__(self, rows: list[dict], known: Statistics | None = None):
        self.rows = rows
        n = len(rows)
        self.left = np.array([len(r["ids"]) - r["used"] for r in rows])
        lengths = np.array([len(r["ids"]) for r in rows])
        term = np.concatenate([r["ids"] for r in rows]).astype(np.int64)
        pair, tf = np.unique(np.repeat(np.arange(n), lengths) * (1 << 32) + term, return_counts=True)
        doc = pair >> 32
        self.terms, slot = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
        known = known or Statistics(n, int(lengths.sum()), holding([r["ids"] for r in rows]))
        df = known.holders[self.terms]
        idf = np.log1p((known.count - df + 0.5) / (df + 0.5))
        weight = idf[slot] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / known.mean))
        self.index = np.zeros((len(self.terms), n), np.float32)  # shard-bounded: terms x SHARD
        self.index[slot, doc] = weight
        self.slots = np.split(slot, np.searchsorted(doc, np.arange(1, n)))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused tails, best score first (ties: in order)."""
        score = self.index[self.slots[seed]].sum(axis=0)
        order = np.argsort(-score, kind="stable")
        return order[(self.left[order] > 0) & (order != seed)]


def fill(shard: Shard, window: int, last: bool):
    """Sequences of (row, start, length) lists; the rows not used up are left in the shard."""
    left = shard.left
    for seed in range(len(left)):
        if not left[seed]:
            continue
        if not last and left.sum() < window:
            return  # the rest waits for the next shard
        used, room = [(seed, min(int(left[seed]), window))], window - min(int(left[seed]), window)
        near = shard.neighbours(seed)
        while room and len(near):
            fits = np.flatnonzero(left[near] <= room)
            k = int(fits[0]) if len(fits) else 0
            take = min(int(left[near[k]]), room)
            used.append((int(near[k]), take))
            room -= take
            near = np.delete(near, k)
        sequence = []
        for row, take in used:
            r = shard.rows[row]
            sequence.append((r, r["used"], take))
            r["used"] += take
            left[row] -= take
        yield sequence


def powers(sequence: list, window: int):
    """The sequence itself if full, else cut into sequences whose lengths are powers of two."""
    n = sum(take for _, _, take in sequence)
    if n == window:
        yield sequence
        return
    rest = list(sequence)
    for bit in reversed(range(n.bit_length())):
        room, out = n & (1 << bit), []
        while room:
            r, at, take = rest.pop(0)
            own = min(take, room)
            out.append((r, at, own))
            room -= own
            if own < take:
                rest.insert(0, (r, at + own, take - own))
        if out:
            yield out


def pack(spark: SparkSession, docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    on demand, ``ids`` (the piece's ids, little-endian unsigned 32-bit)."""
    prepare(spark)
    cut = stored(spark, tails(docs, path, window, with_ids), "pack-tails")
    found = statistics(cut)
    tasks = max(1, -(-found.tokens // TASK_TOKENS), -(-cut.count() // (1 << 20)))
    sent = spark.sparkContext.broadcast((found.count, found.tokens, found.holders))
    dealt = cut.repartitionByRange(tasks, "sketch", "doc_id", "start").sortWithinPartitions("sketch", "doc_id", "start", "doc_tokens")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        known = Statistics(*sent.value)
        waiting: list[dict] = []
        wide = None

        def sequences(last):
            """Fill windows from the waiting tails; what is not used up goes on waiting."""
            shard = Shard(waiting, known)
            for s in fill(shard, window, last):
                yield from powers(s, window)
            waiting[:] = [r for r in waiting if r["used"] < len(r["ids"])]

        def rows(found):
            nonlocal number
            out = [[] for _ in names]
            for sequence in found:
                offset = 0
                for r, at, take in sequence:
                    raw = r["ids"][at : at + take].astype("<u4").tobytes()
                    for column, v in zip(out, (r["doc_id"], r["start"] + at, take, zlib.crc32(raw), r["doc_tokens"], number, offset, raw if with_ids else None)):
                        column.append(v)
                    offset += take
                number += 1
            return pa.record_batch(
                [pa.array(out[0], kind_arrow), *(pa.array(x, pa.int64()) for x in out[1:7]), pa.array(out[7], pa.binary())], names
            )

        kind_arrow = None
        for batch in batches:
            kind_arrow = batch.schema.field("doc_id").type
            whole = batch.filter(pa.compute.is_null(batch.column("sketch")))
            if len(whole):
                ids = number + np.arange(len(whole))
                number += len(whole)
                full = [None if not with_ids else np.frombuffer(x, wide_of(len(x), window)).astype("<u4").tobytes() for x in whole.column("ids").to_pylist()]
                yield pa.record_batch(
                    [*(whole.column(c) for c in names[:5]), pa.array(ids, pa.int64()), pa.array(np.zeros(len(whole), np.int64)), pa.array(full, pa.binary())], names
                )
            for r in batch.filter(pa.compute.is_valid(batch.column("sketch"))).to_pylist():
                wide = wide or wide_of(len(r["ids"]), r["length"])
                waiting.append(r | {"ids": np.frombuffer(r["ids"], wide), "used": 0})
                if len(waiting) >= SHARD:
                    yield rows(sequences(False))
        if waiting:
            yield rows(sequences(True))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    out = dealt.mapInArrow(run, schema)
    return out if with_ids else out.drop("ids")


def wide_of(size: int, n: int) -> str:
    """Width of the stored ids: size bytes for n ids."""
    return "<u2" if size == 2 * n else "<u4"
