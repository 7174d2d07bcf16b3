"""Exact top-k by inner product: three phases with a uniform threshold.

Vectors are cut into ``parts`` groups of components; every part is a list of local scores
(the inner product over its components), and a candidate's score is the sum over the lists.

1. Each list gives every query its ``k`` best local scores. The whole scores of those
   candidates are resolved; the k-th best of them is a safe cutoff t: the result can't
   hold anything lower.
2. The cutoff goes out. A candidate that reaches t has a local score of t / parts or more in
   some list (else the sum stays below t), so each list sends all entries from there on.
3. A candidate's upper bound is its local scores where they were sent and t / parts where they
   weren't; those whose bound misses t are out, and the others' scores are resolved exactly.

Copies of one vector are one class that keeps its k + 1 smallest ids (a query drops its
own), so a vector that a third of all rows share costs as much as any other. Queries are sent in
blocks of ``BLOCK`` vectors: a broadcast of bounded size.

Scores are exact integers: products are summed in float64 where the bound on any sum is below
2**53, else in Python integers that must fit 64 bits (a larger one raises).

Results: vectors that are NULL or hold NULL or non-finite components take no part, as query or
candidate; shorter vectors count as zero-filled, an empty one as zero; NULL ids take no part;
of several rows with one id the least vector counts; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tablewash.llm.common import prepare, stored

PARTS = 2
BLOCK = 4096
#: Candidates whose local scores are held at once.
ROWS = 2048
#: Pairs that are multiplied at once.
PAIRS = 1 << 14


def exact(vectors: DataFrame, scale: int) -> DataFrame:
    """``id``, ``v`` (floor of ``scale`` times each component) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    # in SQL NaN is greater than every number
    clean = clean.where(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))))
    return clean.select("id", F.transform("x", lambda c: F.floor(scale * c).cast("long")).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def matrix(rows: pa.ListArray | list, width: int) -> np.ndarray:
    """The lists as zero-filled rows of ``width``."""
    rows = rows if isinstance(rows, pa.Array) else pa.array(rows, pa.list_(pa.int64()))
    lengths = np.diff(np.asarray(rows.offsets))
    flat = np.asarray(rows.flatten(), np.int64)
    if len(rows) and (lengths == width).all():
        return flat.reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    out[np.repeat(np.arange(len(rows)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        return (a.astype(object) @ b.astype(object).T).astype(np.int64)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def _lists(classes: DataFrame, parts: int, width: int) -> DataFrame:
    """Vertical lists: (part, class, its components)."""
    step = max(1, -(-width // parts))
    return classes.select("c", F.posexplode(F.array(*(F.slice("v", 1 + i * step, step) for i in range(parts)))).alias("part", "piece"))


def _scan(spark: SparkSession, lists: DataFrame, queries: list, parts: int, width: int, k: int, cutoff: dict | None) -> DataFrame:
    """Per list: each query's k best entries, or all from its cutoff on: ``q, part, c, local``."""
    step = max(1, -(-width // parts))
    whole = matrix([v for _, v in queries], max(step * parts, 1))
    names = np.array([q for q, _ in queries], np.int64)
    # cutoff t: entries with parts * local >= t
    least = None if cutoff is None else np.array([cutoff[q] for q in names.tolist()], object)
    if least is not None:
        least = np.array([-(-int(t) // parts) for t in least], np.int64)
    shared = spark.sparkContext.broadcast((whole, names, least))

    def run(batches):
        whole, names, least = shared.value
        best: dict[int, tuple] = {}  # part -> (classes, scores), both (query x at most k)

        def merge(part, classes, scores):
            if part in best:
                classes = np.concatenate([best[part][0], np.broadcast_to(classes, scores.shape)], 1)
                scores = np.concatenate([best[part][1], scores], 1)
            else:
                classes = np.broadcast_to(classes, scores.shape)
            top = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
            best[part] = np.take_along_axis(classes, top, 1), np.take_along_axis(scores, top, 1)

        def batch_of(q, part, c, local):
            return pa.record_batch([pa.array(q), pa.array(np.full(len(q), part, np.int32)), pa.array(c), pa.array(local)], ["q", "part", "c", "local"])

        for batch in batches:
            number, ids = np.array(batch.column("part")), np.array(batch.column("c"))
            flat = batch.column("piece")
            for part in np.unique(number).tolist():
                rows = np.flatnonzero(number == part)
                for at in range(0, len(rows), ROWS):
                    own = rows[at : at + ROWS]
                    local = products(whole[:, part * step : (part + 1) * step], matrix(flat.take(pa.array(own)), step))
                    if least is None:
                        merge(part, ids[own], local)
                    else:
                        q, i = np.nonzero(local >= least[:, None])
                        yield batch_of(names[q], part, ids[own][i], local[q, i])
        for part, (classes, scores) in best.items():
            yield batch_of(np.repeat(names, scores.shape[1]), part, classes.ravel(), scores.ravel())

    found = lists.mapInArrow(run, "q long, part int, c long, local long")
    if cutoff is None:
        by_list = Window.partitionBy("q", "part").orderBy(F.desc("local"), "c")
        found = found.withColumn("r", F.row_number().over(by_list)).where(F.col("r") <= k).drop("r")
    return found


def _resolve(spark: SparkSession, pairs: DataFrame, classes: DataFrame, queries: list, width: int) -> DataFrame:
    """Whole scores of (q, c) pairs: ``q, c, score``.

    A class meets its queries (a block's at most) in one row with one copy of its vector; some
    thousand pairs at a time are multiplied at once."""
    names = np.sort(np.array([q for q, _ in queries], np.int64))
    whole = matrix([v for _, v in sorted(queries)], max(width, 1))
    shared = spark.sparkContext.broadcast((whole, names))

    def run(batches):
        whole, names = shared.value
        for batch in batches:
            v = matrix(batch.column("v"), whole.shape[1])
            lists = batch.column("qs")
            counts = np.diff(np.asarray(lists.offsets))
            q = np.asarray(lists.flatten(), np.int64)
            row = np.repeat(np.arange(len(v)), counts)
            c = np.array(batch.column("c"), np.int64)[row]
            place = np.searchsorted(names, q)
            large = v.size and float(np.abs(v).max()) * float(np.abs(whole).max()) * v.shape[1] >= 2**53
            for at in range(0, len(q), PAIRS):
                x, y = whole[place[at : at + PAIRS]], v[row[at : at + PAIRS]]
                score = (x.astype(object) * y).sum(1).astype(np.int64) if large else np.einsum("ij,ij->i", x, y)
                yield pa.record_batch([pa.array(q[at : at + PAIRS]), pa.array(c[at : at + PAIRS]), pa.array(score, pa.int64())], ["q", "c", "score"])

    asked = pairs.groupBy("c").agg(F.collect_list("q").alias("qs"))
    return asked.join(classes, "c").select("c", "qs", "v").mapInArrow(run, "q long, c long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, every: int, k: int, scale: int = 256, parts: int = PARTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every``, the
    k highest inner products among all vectors but its own, ties to smaller ids."""
    prepare(spark)
    clean = stored(spark, exact(vectors, scale), "topk-vectors")
    width = clean.agg(F.max(F.size("v"))).first()[0] or 0
    # copies: one class (named by its least id and vector), with its k + 1 smallest ids
    smallest = Window.partitionBy("v").orderBy("id")
    kept = clean.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    members = stored(spark, kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.xxhash64("v", F.col("ids")[0]).alias("c"), "v", "ids"), "topk-classes")
    lists = stored(spark, _lists(members, parts, width), "topk-lists")
    asked = clean.where(F.col("id") % every == 0)
    asked = stored(spark, asked.join(members.select("v", F.col("c").alias("q")), "v").select("id", "q"), "topk-queries")
    asking = asked.groupBy("q").agg(F.count("*")).select("q")
    asking = stored(spark, asking.join(members.select(F.col("c").alias("q"), "v"), "q").select("q", "v"), "topk-asking")

    blocks = max(1, -(-asking.count() // BLOCK))
    slot = F.pmod(F.xxhash64("q"), F.lit(blocks))
    results = []
    for b in range(blocks):  # one scan per block of queries; a block's size is bounded
        queries = [(r["q"], r["v"]) for r in asking.where(slot == b).collect()]
        if not queries:
            continue
        # k + 1 entries (a class may be the query's own); classes of several ids only add more
        first = _scan(spark, lists, queries, parts, width, k + 1, None).select("q", "c").distinct()
        scored = _resolve(spark, first, members.select("c", "v"), queries, width)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
        kth = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("q").agg(F.min("score").alias("t"), F.count("*").alias("n"))
        low = -(2**62)
        cutoff = {r["q"]: int(r["t"]) if r["n"] == k + 1 else low for r in kth.collect()}  # one number per query of the block
        sent = _scan(spark, lists, queries, parts, width, k + 1, cutoff)
        t = spark.createDataFrame(list(cutoff.items()), "q long, t long")
        bound = sent.groupBy("q", "c").agg(F.sum("local").alias("seen"), F.count("*").alias("lists")).join(F.broadcast(t), "q")
        # not sent: below t / parts
        bound = bound.where((F.col("t") == low) | (F.col("seen") * parts + (parts - F.col("lists")) * F.col("t") >= F.col("t") * parts))
        results.append(stored(spark, _resolve(spark, bound.select("q", "c"), members.select("c", "v"), queries, width), "topk-scores"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    scores = results[0]
    for r in results[1:]:
        scores = scores.union(r)
    # the k + 1 best ids of each asking class, then each query without its own id
    listed = scores.join(members.select("c", "ids"), "c").select("q", F.explode("ids").alias("vec_id"), "score")
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1).drop("r")
    answers = asked.select("id", "q").join(listed, "q").where("vec_id != id")
    by_query = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
