"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character 3- to 6-grams (hashed, with
word ends marked), so a misspelling that was never seen still shares most of its
vectors with the word it stands for. A passage of ``PASSAGE`` words is the mean
of its words; a linear softmax tells toxic from clean. Vectors and softmax are
trained together in numpy on passages of a bounded sample of labelled documents.
Labels are of whole documents, so training picks, in turns, the passages that look
worst in each document (by the vectors so far; at first, by how many documents of
either label hold the n-grams) and learns from those. A document's score is that of
its worst passage, turned into a probability by a logistic fit on sampled documents
that the vectors didn't see.

Scoring is linear per word (softmax of a mean), so a text is scored with a few
array passes over its bytes; every passage of every text counts, at any length.

Results: NULL, empty and blank texts get the score of a passage without any
evidence; repeated rows are scored row by row; NULL ids and other columns pass;
without labels of both kinds every score is the share of toxic labels (0.0 if
there are none); an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewash.functions.names import c
from tablewash.llm.common import mix, prepare, segments, slices, spans, stored

#: Words of a passage (chosen with MIN_DOCS by cross-validation on training rows of the smaller tables).
PASSAGE = 3
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 8
#: Rounds of training; the passages are picked anew every ``PICK`` rounds.
ROUNDS, PICK, RATE, SMOOTH = 60, 10, 0.03, 3.0
#: Passages picked per document: of a toxic one those near its worst, of a clean one its worst.
TOP_TOXIC, TOP_CLEAN = 3, 6
#: Sampled labelled documents of each class, and the longest that is sampled (bytes).
SAMPLE, SAMPLE_BYTES = 1000, 1 << 14
#: Hash buckets that the sampled ids are cut by (2 ** BUCKET_BITS).
BUCKET_BITS = 14
#: Decay of vectors, softmax and bias; gradients well below the floor move little.
DECAY, FLOOR = (2e-3, 0.0, 0.0), 1e-4
#: Words of fewer sampled documents teach nothing (their n-grams may, in other words).
MIN_DOCS = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(bucket, word number) of all n-grams of the words in ``buf``, word starts, number of words."""
    buf = _LOWER[buf]
    a, b = spans(buf)
    word = np.full(len(buf) + max(GRAMS), -1, np.int32)
    step = np.zeros(len(buf) + 1, np.int32)
    step[a] += 1
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[a] += 1
    inside[b] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    numbers = np.cumsum(step[:-1]) - 1
    # the white space after a word counts as its end mark, that before it as its start mark
    word[: len(buf)] = np.where(inside, numbers, -1)
    text = np.where(inside, buf, 0).astype(np.uint64)
    text = np.concatenate([np.zeros(1, np.uint64), text, np.zeros(max(GRAMS), np.uint64)])
    buckets, owners = [], []
    h = text[:-1] * np.uint64(0x9E3779B1) + text[1:]
    for n in range(2, max(GRAMS) + 1):
        # h[i]: hash of text[i : i + n], text[0] being the mark before the first word
        if n > 2:
            h = h[:-1] * np.uint64(0x9E3779B1) + text[n - 1 :][: len(h) - 1]
        if n in GRAMS:
            # middle letters belong to one word; either end may be a mark
            first = word[: len(h)]  # word of text[i + 1]
            last = word[n - 3 :][: len(h)] if n > 2 else first  # word of text[i + n - 2]
            ok = (first >= 0) & (first == last)
            at = np.flatnonzero(ok)
            buckets.append((mix(h[at] + np.uint64(n)) >> np.uint64(64 - 17)).astype(np.int32))
            owners.append(first[at])
    return np.concatenate(buckets), np.concatenate(owners), a, len(a)


class Model:
    """Weight of each bucket towards "toxic" (vectors times softmax), bias, logistic fit."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.bias, self.slope, self.shift = weight, bias, slope, shift

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every word, and the words per text."""
        values, counts = [np.zeros(0)], np.zeros(len(texts), np.int64)
        for ids, offsets, buf in segments(texts):
            bucket, owner, starts, n = grams(buf)
            if not n:
                continue
            total = np.bincount(owner, self.weight[bucket], n)
            values.append(total / np.maximum(np.bincount(owner, minlength=n), 1))
            np.add.at(counts, ids[np.searchsorted(offsets, starts, side="right") - 1], 1)
        return np.concatenate(values), counts

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Highest passage logit of each text (the bias alone without words)."""
        values, counts = self.words(texts)
        out = np.full(len(texts), self.bias)
        if len(values):
            ends = np.repeat(np.cumsum(counts), counts)
            at = np.arange(len(values))
            stop = np.minimum(at + PASSAGE, ends)
            sums = np.concatenate([[0.0], np.cumsum(values)])
            # a passage at the end of a text is filled up with words without weight
            mean = (sums[stop] - sums[at]) / PASSAGE
            full = counts > 0
            out[full] = np.maximum.reduceat(mean, (np.cumsum(counts) - counts)[full]) + self.bias
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of a weighted one-variable logistic fit."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, v = w * (p - y), w * p * (1 - p)
        ga, gb = (g * x).sum() + 1e-2 * a, g.sum()
        haa, hab, hbb = (v * x * x).sum() + 1e-2, (v * x).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db) / 4, 1e-9))
        a, b = max(a - scale * da, 1e-3), b - scale * db
    return float(a), float(b)


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """``share``: of toxic documents among all labelled ones (the sample is balanced)."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 4 == 3
    own = [t for t, h in zip(texts, held) if not h]
    truth = labels[~held]
    # words of enough documents, their n-grams, and passages that hold any of them
    split = [t.lower().split() for t in own]
    spread_of = Counter(itertools.chain.from_iterable(map(set, split)))
    word_of = {w: i for i, w in enumerate(sorted(w for w, n in spread_of.items() if n >= MIN_DOCS))}
    passages, owner = [], []
    for i, words in enumerate(split):
        ids = [word_of.get(w, -1) for w in words]
        for at in range(0, max(len(ids), 1), PASSAGE):
            piece = ids[at : at + PASSAGE]
            passages.append(piece + [-1] * (PASSAGE - len(piece)))
            owner.append(i)
    passages, owner = np.array(passages), np.array(owner)
    if not word_of:
        return Model(np.zeros(BUCKETS), 0.0, 1e-3, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    bucket, word, _, n = grams(np.frombuffer(b" ".join(word_of) + b" ", np.uint8))
    order = np.argsort(word, kind="stable")
    bucket, word = bucket[order], word[order]
    share_of = 1 / np.maximum(np.bincount(word, minlength=n), 1)
    starts = np.searchsorted(word, np.arange(n))
    used, bucket = np.unique(bucket, return_inverse=True)
    # first vectors: smoothed log odds of an n-gram's documents, in one dimension
    pairs = [np.unique([i * n + word_of[w] for w in set(words) if w in word_of]) for i, words in enumerate(split)]
    pairs = np.concatenate([x.astype(np.int64) for x in pairs])
    begin, width = starts[pairs % n], np.diff(np.append(starts, len(word)))[pairs % n]
    doc_gram = np.repeat(pairs // n, width) * len(used)
    doc_gram += bucket[np.repeat(begin, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
    doc_gram = np.unique(doc_gram)
    toxic = truth[doc_gram // len(used)]
    in_toxic, in_clean = (np.bincount(doc_gram[toxic == y] % len(used), minlength=len(used)) for y in (1, 0))
    odds = np.log((in_toxic + SMOOTH) / (truth.sum() + SMOOTH)) - np.log((in_clean + SMOOTH) / ((truth == 0).sum() + SMOOTH))
    params = [rng.normal(0, 0.02, (len(used), DIM)), rng.normal(0, 0.3, DIM), np.zeros(1)]
    params[0][:, 0], params[1][0] = odds, 4.0
    m, v = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    label = truth[owner].astype(float)
    begins = np.flatnonzero(np.diff(owner, prepend=-1))

    def forward(rows):
        vectors = np.add.reduceat(params[0][bucket], starts, axis=0) * share_of[:, None]
        filled = passages[rows] >= 0
        flat, at = passages[rows][filled], np.repeat(np.arange(len(rows)), filled.sum(1))
        means = np.stack([np.bincount(at, vectors[flat, d], len(rows)) for d in range(DIM)], 1) / PASSAGE
        return flat, at, means, means @ params[1] + params[2][0]

    every = np.arange(len(owner))
    rows = every
    for step in range(1, ROUNDS + 1):
        if step % PICK == 1:
            z = forward(every)[3]
            best = np.maximum.reduceat(z, begins)[owner]
            order = np.lexsort((-z, owner))
            rank = np.empty(len(order), np.int64)
            rank[order] = every - begins[owner[order]]
            near = z >= best - 0.3 * np.abs(best - np.median(z))
            rows = np.flatnonzero(np.where(label == 1, near & (rank < TOP_TOXIC), rank < TOP_CLEAN))
        flat, at, means, z = forward(rows)
        p, y = 1 / (1 + np.exp(-np.clip(z, -30, 30))), label[rows]
        w = np.where(y == 1, 1 / max((y == 1).sum(), 1), 1 / max((y == 0).sum(), 1))
        g = w * (p - y)
        g_means = g[:, None] * params[1][None, :] / PASSAGE
        g_words = np.stack([np.bincount(flat, g_means[at, d], n) for d in range(DIM)], 1) * share_of[:, None]
        spread = g_words[word]
        g_table = np.stack([np.bincount(bucket, spread[:, d], len(used)) for d in range(DIM)], 1)
        grads = [g_table, means.T @ g, g.sum(keepdims=True)]
        for k, grad in enumerate(grads):  # Adam
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.98 * v[k] + 0.02 * grad * grad
            size = np.sqrt(v[k] / (1 - 0.98**step)) + FLOOR
            params[k] = params[k] * (1 - DECAY[k]) - RATE * (m[k] / (1 - 0.9**step)) / size
    table, head, bias = params[0], params[1], params[2][0]
    weight = np.zeros(BUCKETS)
    weight[used] = table @ head
    model = Model(weight, float(bias), 1.0, 0.0)
    late = [t for t, h in zip(texts, held) if h]
    y = labels[held].astype(float)
    if len(set(y)) == 2:
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.slope, model.shift = logistic(model.logits(late), y, w)
    return model


def sample_of(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, size: int, longest: int) -> tuple[list[bytes], np.ndarray, float]:
    """At most ``size`` texts of either label (those of least id hash, of at most ``longest`` bytes)
    and the share of label 1 among all allowed labelled documents.

    Ids come first: (id, text hash) of the texts that may be sampled meet their labels, hash
    buckets are counted, and only ids up to the bucket that fills the sample go to the driver, whatever
    the input's size. Their texts then come from one more scan, which the chosen ids are broadcast to."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label")).where(allowed)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    text = F.col("text").cast("string")
    short = docs.where(text.isNotNull() & (F.octet_length(text) <= longest))
    rows = short.select("doc_id", F.xxhash64(text).alias("h")).join(known, "doc_id")
    order = F.xxhash64("doc_id")
    rows = rows.select("doc_id", "h", "label", order.alias("o"), F.shiftrightunsigned(order, 64 - BUCKET_BITS).alias("bucket"))
    rows = stored(spark, rows, "sample-ids")
    filled = rows.groupBy("label", "bucket").count().collect()  # 2 x 2**BUCKET_BITS rows at most
    chosen: list = []
    for y in (0, 1):
        # unsigned hashes: buckets in order, the signs' halves swapped back by the final sort
        total, last = 0, -1
        for r in sorted((r for r in filled if r["label"] == y), key=lambda r: r["bucket"]):
            total, last = total + r["count"], r["bucket"]
            if total >= size:
                break
        own = rows.where((F.col("label") == y) & (F.col("bucket") <= last)).select("doc_id", "h", "o").distinct()
        chosen += [(r["doc_id"], r["h"], y) for r in own.orderBy(F.shiftrightunsigned("o", 1), "o", "doc_id", "h").limit(size).collect()]
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not chosen:
        return [], np.zeros(0, np.int64), share
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame(chosen, f"doc_id {kind}, h long, label int"))  # 2 x size rows at most
    found = short.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).join(wanted, ["doc_id", "h"])
    texts = found.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text")).select("text", "label").collect()
    texts.sort(key=lambda r: (zlib.crc32(r["text"].encode()), r["text"]))  # mixes the labels
    return [r["text"].encode() for r in texts], np.array([r["label"] for r in texts]), share


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic") -> Model:
    texts, y, share = sample_of(docs, labels, label, allowed, SAMPLE, SAMPLE_BYTES)
    if len(set(y.tolist())) < 2:
        even = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(BUCKETS), 0.0, 1e-3, float(even))
    return train(texts, y, share)


def score(spark: SparkSession, docs: DataFrame, model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its ``text`` (a column of that name is replaced)."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # one bounded table of weights
    kept = [x for x in docs.columns if x != name]
    # plain names while Python has the rows: a dot or a backquote in a caller's name means nothing there
    plain = [f"x{i}" for i in range(len(kept))]
    schema = ", ".join(f"{x} {docs.schema[y].dataType.simpleString()}" for x, y in zip(plain, kept))

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(plain[kept.index("text")]).to_pylist()
            for a, b in slices(texts):
                found = own.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]])
                yield pa.record_batch([*(batch.column(x).slice(a, b - a) for x in plain), pa.array(found, pa.float64())], [*plain, "score"])

    own = docs.select(*(c(y).alias(x) for x, y in zip(plain, kept)))
    return own.mapInArrow(run, f"{schema}, score double").toDF(*kept, name)
