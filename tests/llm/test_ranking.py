"""Ranked search against a plain scorer; the sharing DAG against the items' own term sets."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablewash.llm import queries, ranking

SF = "/root/testdata/sf0.001"


def terms_of(text):
    lowered = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_force(docs, items, k=50):
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    i = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    return sorted((tuple(r) for r in ranking.rank(spark, d, i, **options).collect()), key=repr)


@pytest.mark.parametrize("seed, block", [(1, 1 << 16), (2, 40)])
def test_random_tables(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ranking, "CELLS", 1)  # sixteen documents at a time
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "ß", "漢字", "a1", "7"]
    shared = " ".join(words[:9])

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", ", "]) for _ in range(n))

    docs = [(rng.choice([None, *range(300)]), text(rng.randint(0, 30)).upper() if rng.random() < 0.2 else text(rng.randint(0, 30))) for _ in range(400)]
    docs += [(5, "w1 w2 w3 w4")] * 20 + [(i, "w1 w2 w3 w4") for i in range(900, 860, -1)] + [(1000, None), (1001, ""), (1002, "-"), (1003, text(40_000))]
    items = [(i, (shared if i % 2 else "") + " " + text(rng.randint(0, 12))) for i in range(30)] + [(3, "w1"), (None, "w2 w3"), (None, "w4"), (77, None), (78, "nowhere")]
    assert ranked(spark, docs, items, k=7, block_terms=block) == brute_force(docs, items, 7)


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == ranked(spark, [(1, "a")], []) == ranked(spark, [(1, "-"), (2, None)], [(1, "a")]) == []
    assert ranked(spark, [(1, "a")], [(1, "a")]) == brute_force([(1, "a")], [(1, "a")]) != []


def test_sharing_keeps_the_term_sets():
    rng = random.Random(4)
    common = [rng.sample(range(200), 12) for _ in range(6)]
    items = [sorted(set(rng.sample(range(300), 15) + sum(rng.sample(common, 2), []))) for _ in range(80)] + [[], [7]]
    plan = ranking.Plan(items, 300)
    sets = [{t for t in range(300) if plan.atom[t] == a} for a in range(plan.atoms)]
    for a, b in plan.rounds:
        for x, y in zip(a, b):
            assert not sets[x] & sets[y]
            sets.append(sets[x] | sets[y])
    left = [plan.left[plan.items == i] for i in range(len(items))]
    for own, nodes in zip(items, left):
        assert sorted(t for n in nodes for t in sets[n]) == own  # disjoint and complete
    sums = sum(len(a) for a, _ in plan.rounds) + sum(len(x) for x in left)
    assert plan.rounds and sums < 0.75 * sum(map(len, items))
    # and their sums are the items' own
    value = np.array([rng.randrange(1000) for _ in range(300)])
    scores = plan.scores(np.repeat([0, 1], 300), np.tile(np.arange(300), 2), np.concatenate([value, value * 2]), 2, len(items))
    assert scores[:, 0].tolist() == [int(value[i].sum()) for i in items] and (scores[:, 1] == 2 * scores[:, 0]).all()


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_ranking(spark, SF).collect()), key=repr)
    assert got == brute_force(docs, items)
