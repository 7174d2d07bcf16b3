"""Ranked lexical search: many queries at once over shared sub-expressions.

A term is a maximal run of ASCII letters and digits and of code points from U+0080 on, A-Z lower-cased. An
item's score of a document is the sum, over the item's distinct terms, of

    w * ((1000000000 * tf) div (1000 * tf + 20 * m)),   w = floor(1000 * ln((2 N + 2) / (2 df + 1))),
    m = 100 - 50 + ((50 * n * N) div L),

N documents with a term, L all their terms, n the document's terms, df documents that hold the term, tf
its count in the document; all but the logarithm in 64-bit integers. It is a sum, so items that share a set of
terms share its sum:

1. Items' distinct terms are made in Spark and dealt to blocks of about ``BLOCK_TERMS`` terms; a block's terms
   go to the driver and out again (a broadcast of bounded size). The texts are read once per block: each
   document keeps (term, tf) of the block's terms. N, L and df are counted over all documents.
2. ``Plan``: terms that the same items hold form one atom. Then the pairs of nodes that most items share are
   merged into new nodes, disjoint pairs of a round at once, as long as two items share a pair: a query-sharing
   DAG in which each node stands for a set of terms, computed once for all items that hold the set.
3. For some hundred documents at a time, the atoms' accumulators are filled from (term, tf), each round's
   nodes are the sums of two earlier ones, and an item is the sum of the few nodes that are left of it.
4. A task keeps each item's ``k`` best so far (what misses the k-th score is out at once); the tasks' lists
   are merged in two steps, so no group grows with the input but by ``k`` rows a task, split over ``FANS``.

All documents are scored in full: nothing is pruned by a bound or a cap.

Results: NULL texts and those without terms have no score and don't count; items without terms, or whose terms no document
holds, give no rows; rows of one item_id are one item with the terms of all (a NULL id too); each
document row counts and is ranked by itself, repeated ones too; ties go by ascending doc_id, NULL ids last; only
scores above 0 are listed; long texts are read whole; empty tables give no rows; other columns are ignored.
Terms are looked up by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tablewash.llm.common import prepare, segments, slices, span_hashes, stored

#: What a term is made of, as a pattern over code points (fixed value).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) pairs of one block of items.
BLOCK_TERMS = 1 << 16
#: Accumulators (nodes x documents) held at once.
CELLS = 1 << 21
#: Rounds of merging, and the nodes that a round looks at (a saving, not a limit on results).
ROUNDS, LOOK = 24, 1024
#: Candidates that a task holds before it drops those beyond each item's k best.
HELD = 1 << 18
#: Groups that an item's lists are merged in first.
FANS = 16

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every term."""
    inside = _TERM_BYTE[buf]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return span_hashes(_LOWER[buf], edge[::2], edge[1::2]), edge[::2]


class Vocabulary:
    """Hashes of a block's terms, in order, and their numbers."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(t) + 1 for t in raw], dtype=np.int64) - 1
        buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        hashes = span_hashes(buf, ends - np.array([len(t) for t in raw], np.int64), ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Terms of each text, and of its terms that are here (numbers, counts)."""
        total = np.zeros(len(texts), np.int64)
        found = []
        for ids, offsets, buf in segments(texts):
            h, at = term_hashes(buf)
            owner = ids[np.searchsorted(offsets, at, side="right") - 1]
            total += np.bincount(owner, minlength=len(texts))
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[place] == h
            found.append(owner[hit].astype(np.int64) << 32 | self.order[place[hit]])
        pair, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        cuts = np.searchsorted(pair >> 32, np.arange(1, len(texts)))
        return total, list(zip(np.split(pair & 0xFFFFFFFF, cuts), np.split(tf, cuts)))


def postings(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """``doc_id, n, terms, tfs`` (packed unsigned 32-bit) of the documents that have terms."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        own = sent.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in slices(texts):
                n, found = own.counts([(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]])
                keep = np.flatnonzero(n)
                packed = [[found[i][j].astype("<u4").tobytes() for i in keep.tolist()] for j in (0, 1)]
                yield pa.record_batch([ids.take(pa.array(a + keep)), pa.array(n[keep]), *(pa.array(x, pa.binary()) for x in packed)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def holders(found: DataFrame, size: int) -> np.ndarray:
    """By term: documents that hold it (one row per term and task, summed in Spark)."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw = b"".join(batch.column("terms").to_pylist())
            total += np.bincount(np.frombuffer(raw, "<u4"), minlength=size)
        terms = np.flatnonzero(total)
        yield pa.record_batch([pa.array(terms), pa.array(total[terms])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)


class Plan:
    """The query-sharing DAG of some items (lists of distinct term numbers below ``size``)."""

    def __init__(self, items: list[list[int]], size: int):
        held: dict[int, list[int]] = {}
        for i, terms in enumerate(items):
            for t in terms:
                held.setdefault(t, []).append(i)
        # atoms: terms that the same items hold
        atoms: dict[tuple, int] = {}
        self.atom = np.full(size, -1, np.int64)
        for t in sorted(held):
            self.atom[t] = atoms.setdefault(tuple(held[t]), len(atoms))
        holds = np.zeros((len(items), len(atoms)), bool)
        for owners, a in atoms.items():
            holds[list(owners), a] = True
        self.atoms = len(atoms)
        #: of each round: its nodes are the sums of these earlier ones
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(ROUNDS):
            pairs = self._shared(holds)
            if not len(pairs):
                break
            a, b = pairs.T
            both = holds[:, a] & holds[:, b]
            holds[:, a] &= ~both
            holds[:, b] &= ~both
            holds = np.concatenate([holds, both], 1)
            self.rounds.append((a, b))
        self.nodes = holds.shape[1]
        self.items, self.left = np.nonzero(holds)  # what is left of each item, in item order

    @staticmethod
    def _shared(holds: np.ndarray) -> np.ndarray:
        """Disjoint pairs of nodes that two items or more hold, those of most items first."""
        spread = holds.sum(0)
        look = np.argsort(-spread, kind="stable")[:LOOK]
        look = look[spread[look] >= 2]
        m = holds[:, look].astype(np.float32)
        together = np.triu(m.T @ m, 1)
        x, y = np.nonzero(together >= 2)
        order = np.argsort(-together[x, y], kind="stable")
        taken = np.zeros(len(look), bool)
        out = []
        for i in order.tolist():
            if not (taken[x[i]] or taken[y[i]]):
                taken[x[i]] = taken[y[i]] = True
                out.append((look[x[i]], look[y[i]]))
        return np.array(out, np.int64).reshape(-1, 2)

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int, items: int) -> np.ndarray:
        """(item x document) sums of ``value`` over the items' terms."""
        used = self.atom[term] >= 0
        acc = np.zeros((self.nodes, docs), np.int64)
        np.add.at(acc, (self.atom[term[used]], doc[used]), value[used])
        at = self.atoms
        for a, b in self.rounds:
            np.add(acc[a], acc[b], out=acc[at : at + len(a)])
            at += len(a)
        out = np.zeros((items, docs), np.int64)
        if len(self.left):
            begin = np.flatnonzero(np.diff(self.items, prepend=-1))
            out[self.items[begin]] = np.add.reduceat(acc[self.left], begin, axis=0)
        return out


class Best:
    """Each item's k best documents so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # scores below this are out
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.parts.append((item, scores[item, doc], ids[doc], none[doc]))
        self.held += len(item)
        if self.held > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, ids, none = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        begin = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
        keep = order[rank < self.k]
        last = rank == self.k - 1
        self.least[item[last]] = score[order][last]
        out = (item[rank < self.k], score[keep], ids[keep], none[keep])
        self.parts, self.held = [out], len(keep)
        return out


def _lists(spark: SparkSession, found: DataFrame, plan: Plan, w: np.ndarray, n_docs: int, n_terms: int, names: list, kind, k: int) -> DataFrame:
    """``item_id, doc_id, score``: each task's k best of every item."""
    sent = spark.sparkContext.broadcast((plan, w, pa.array(names, kind)))
    step = max(16, CELLS // max(plan.nodes, 1))

    def run(batches):
        plan, w, names = sent.value
        best = Best(len(names), k)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                own = batch.slice(at, step)
                lengths = np.array([len(x) // 4 for x in own.column("terms").to_pylist()], np.int64)
                term, tf = (np.frombuffer(b"".join(own.column(x).to_pylist()), "<u4").astype(np.int64) for x in ("terms", "tfs"))
                doc = np.repeat(np.arange(own.num_rows), lengths)
                n = np.array(own.column("n"), np.int64)
                m = 50 + 50 * n * n_docs // n_terms
                value = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                ids = own.column("doc_id")
                none = np.array(ids.is_null())
                best.add(plan.scores(doc, term, value, own.num_rows, len(names)), np.array(ids.fill_null(0), np.int64), none)
        item, score, ids, none = best.cut()
        yield pa.record_batch([names.take(pa.array(item)), pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return found.mapInArrow(run, f"item_id {spark_type(kind)}, doc_id long, score long")


def spark_type(kind) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    from pyspark.sql.pandas.types import to_arrow_type

    prepare(spark)
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    asked = items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    asked = stored(spark, asked, "rank-items")
    blocks = max(1, -(-asked.count() // block_terms))
    kind = to_arrow_type(items.schema["item_id"].dataType)
    slot = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    lists = []
    size: tuple[int, int] | None = None
    for b in range(blocks):
        rows = asked.where(slot == b).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        if not rows:
            continue
        terms = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        found = stored(spark, postings(docs, Vocabulary(terms)), "rank-postings")
        if size is None:
            n, total = found.agg(F.count("*"), F.sum("n")).first()
            size = (n, total or 0)
        if not size[0]:
            break
        w = weights(holders(found, len(terms)), size[0])
        plan = Plan([[number[t] for t in r["terms"] if w[number[t]]] for r in rows], len(terms))
        lists.append(_lists(spark, found, plan, w, *size, [r["item_id"] for r in rows], kind, k))
    if not lists:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    merged = lists[0]
    for x in lists[1:]:
        merged = merged.unionByName(x)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    merged = merged.withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(FANS)))
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "fan").orderBy(*best))).where(F.col("rank") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
