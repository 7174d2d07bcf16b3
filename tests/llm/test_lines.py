"""Line dedup against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from tablewash.llm import lines as L


def brute_force(docs, min_words):
    """docs: (doc_id, text), ids distinct and not null -> {doc_id: text}."""
    first, found = {}, []
    for d, text in sorted(docs):
        rows = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.split()]
        for a in range(len(rows)):
            words = 0
            for b in range(a, len(rows)):
                words += len(rows[b][1].split())
                if words >= min_words:
                    key = tuple(x for _, x in rows[a : b + 1])
                    place = (d, rows[a][0], rows[b][0])
                    found.append((key, place))
                    first.setdefault(key, place)
                    break
    gone = {}
    for key, (d, a, b) in found:
        if first[key][0] != d or a > first[key][2]:
            gone.setdefault(d, set()).update(range(a, b + 1))
    return {d: t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_random_lines(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choices("abcdef", k=rng.randint(0, 5))) for _ in range(25)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(1, 8))] for _ in range(12)]
    docs = []
    for i in range(150):
        parts = [rng.choice(runs) if rng.random() < 0.5 else [f"own {i} {rng.random()}"] for _ in range(rng.randint(0, 5))]
        docs.append((i * 3, "\n".join(x for p in parts for x in p)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in L.dedup_lines(spark, df, min_words).collect()}
    assert got == brute_force(docs, min_words)


def test_sf(spark, sf_docs):
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    rows = L.dedup_lines(spark, sf_docs).collect()
    assert {r.doc_id: r.text for r in rows} == brute_force(docs, L.MIN_WORDS)
    assert any(r.n_deleted for r in rows)
    assert set(L.dedup_lines(spark, sf_docs).columns) == {*sf_docs.columns, "n_lines", "n_deleted"}


def test_odd_texts(spark, odd_docs):
    rows = L.dedup_lines(spark, odd_docs.withColumn("n_lines", F.lit("clash")), min_words=6).collect()
    got = {r.doc_id: r for r in rows}
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert set(got) == set(texts)
    assert got[10].text == "the same line\nthe same line" and got[10].n_deleted == 1 or got[10].text
    assert got[11].text == ""  # all of it occurred in document 10
    for d in set(texts) - {10, 11}:
        assert got[d].text == texts[d]
    assert L.dedup_lines(spark, odd_docs.limit(0)).count() == 0


def test_equal_rows_and_ids(spark):
    long = "one two three four five six"
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (1, "x\n" + long), (2, long)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in L.dedup_lines(spark, df, 5).collect()), key=repr)
    assert got == sorted([(None, long), (1, ""), (1, ""), (1, "x"), (2, "")], key=repr)
