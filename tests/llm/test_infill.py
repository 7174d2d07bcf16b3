"""Fill-in-middle cuts against a plain split into units, and round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewash.llm import infill, queries

SF = "/root/testdata/sf0.001"


def brute_force(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def whole(texts):
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ <PSM>é漢😀\n0", max_size=60), min_size=1, max_size=8), st.integers(1, 9), st.integers(0, 1 << 62))
def test_random_texts_and_blocks(texts, block, seed):
    before, infill.BLOCK = infill.BLOCK, block
    try:
        ids = [seed + i for i in range(len(texts))]
        got = list(zip(*infill.transform(ids, *whole(texts))))
    finally:
        infill.BLOCK = before
    assert [(*g[:4], g[4].decode()) for g in got] == [brute_force(i, t) for i, t in zip(ids, texts)]


def test_every_cut_of_a_text():
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "é", "漢", "😀", "x", "\n", "7"]) for _ in range(3000))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    ends = [0]
    for u in units:
        ends.append(ends[-1] + len(u))
    buf, starts, stops = whole(["", text, "ab", ""])
    blocks = infill.Blocks(buf, starts, stops)
    assert blocks.totals(0).tolist() == [0, len(units), 1, 0]
    assert blocks.totals(1).tolist() == [0, len(text), 2, 0]
    k = np.arange(len(units) + 1)
    place, chars = blocks.cut(np.ones(len(k), np.int64), k)
    assert chars.tolist() == ends
    assert place.tolist() == [len(text[:e].encode()) for e in ends]


def test_rows(spark):
    long = ("word é " * 400_000) + "<S"
    texts = [None, "", " ", "a", "plain <M> text", "<P", "x<S", long, "a" * 3_000_000, "é" * 70_000]
    rows = [(i % 7 if i else None, texts[i % len(texts)], f"{i}!") for i in range(60)]
    docs = spark.createDataFrame([(*r, *["kept"] * 5) for r in rows], "doc_id long, text string, `a.b` string, x0 string, own_id string, own_text string, form string, n string").repartition(5)
    out = infill.infill(spark, docs)
    assert out.columns == ["doc_id", "text", "a.b", "x0", "own_id", "own_text", *infill.ADDED]
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == 60
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_force(r.doc_id, r.text)
        assert r.back == (r.text or "") and (r.x0, r.own_id, r.own_text) == ("kept",) * 3 and r["a.b"].endswith("!")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infill(spark, docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_infill(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, output = brute_force(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
