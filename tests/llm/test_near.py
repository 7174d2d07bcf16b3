"""The n-gram Jaccard join against a brute-force version."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewash.llm import near
from tablewash.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)} if words else set()


def brute_force(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, (_, t) in enumerate(rows)}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for hs in holders.values():
        for x in range(len(hs)):
            for y in range(x):
                common[hs[y], hs[x]] += 1
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, y), n in common.items():
        if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
            root[find(x)] = find(y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def result(spark, df, k, percent):
    return sorted((tuple(r) for r in near.near_components(spark, df, k, percent).collect()), key=repr)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_edited_copies(spark, k, percent):
    """Chains of copies, each a little further from the first: links run through the middle ones."""
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(1, 150))
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    boiler = " ".join(rng.choices(vocabulary, k=40))  # a passage that many texts share
    rows += [(len(rows) + i, boiler + " " + " ".join(rng.choices(vocabulary, k=rng.randint(2, 60)))) for i in range(60)]
    rng.shuffle(rows)
    assert result(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent) == brute_force(rows, k, percent)


def test_sf_and_odd_texts(spark, sf_docs, odd_docs):
    docs = sf_docs.select("doc_id", "text").union(odd_docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = [tuple(r) for r in docs.collect()]
    assert result(spark, docs, 4, 85) == brute_force(rows, 4, 85)
    assert near.near_components(spark, odd_docs.limit(0), 4, 85).count() == 0
    assert near.near_components(spark, odd_docs.where("text is null"), 4, 85).collect()[0].n_shingles == 0


def test_repeated_rows(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "A b\tc D e"), (3, "x y"), (1, "x y"), (2, "x  Y"), (None, None), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spark, docs, 4, 85) == brute_force(rows, 4, 85)


def test_large_texts_with_a_common_passage(spark, monkeypatch):
    """Only pairs that may link are verified: those of a passage alone would grow with the square of its texts."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1200, 1500)))) for i in range(40)]
    rows += [(len(rows) + i, t + " " + " ".join(f"q{rng.randrange(5000)}" for _ in range(m))) for i, ((_, t), m) in enumerate(zip(rows, (20, 100, 200, 280, 320, 420)))]
    tried, verified = [], near.verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near, "verified", counted)
    got = result(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert got == brute_force(rows, 5, 80)
    assert len({x[2] for x in got}) < len(rows) - 3 and sum(tried) < 20


def test_fine_sketches_bound_the_difference():
    """Also of sets whose sketches differ in length, and of those beyond the longest sketch."""
    rng = np.random.default_rng(2)
    for n in (500, 1000, 1020, 2040, 3000, near.FINE_BITS - 500):
        for extra in (0, 1, 30, n // 5):
            for common in (n - extra, n):
                x = rng.integers(0, 2**63, common).astype(np.uint64)
                y = np.concatenate([x, rng.integers(0, 2**63, extra).astype(np.uint64)])
                fine = near.fine_sketches(np.concatenate([x, y]), np.array([len(x), len(y)]))
                assert [f and len(f) * 8 for f in fine] == [None if m <= near.BITS else min(1 << (m - 1).bit_length(), near.FINE_BITS) for m in (len(x), len(y))]
                if None not in fine:
                    there, back = near.distances([fine[0], fine[1]], [fine[1], fine[0]]).tolist()
                    assert there == back <= extra and there % 2 == extra % 2
    unlike = near.fine_sketches(rng.integers(0, 2**63, 4000).astype(np.uint64), np.array([2000, 2000]))
    assert near.distances(unlike[:1], unlike[1:])[0] > 800
    assert near.fine_sketches(np.zeros(0, np.uint64), np.zeros(3, np.int64)) == [None] * 3


def test_sketch_distance_bounds_the_difference():
    """Linked sets agree in a dealt piece, and the bands hold every size once."""
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        for n in [1, 2, 3, 5, 8, 13, 40, 200, 900]:
            for _ in range(30):
                common = rng.integers(0, 2**63, n).astype(np.uint64)
                extra = rng.integers(0, 2**63, rng.integers(0, n // 5 + 1)).astype(np.uint64)
                cut = rng.integers(0, len(extra) + 1)
                x, y = np.concatenate([common, extra[:cut]]), np.concatenate([common, extra[cut:]])
                if 100 * n >= percent * (n + len(extra)):
                    key, per = near.pieces(np.concatenate([x, y]), np.array([len(x), len(y)]), percent)
                    assert set(key[: per[0]].tolist()) & set(key[per[0] :].tolist())


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(tuple(r) for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in root if x in got}
    assert set(got) >= {x for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
