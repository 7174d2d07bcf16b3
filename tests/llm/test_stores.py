"""WARC round trip, exact top-k, rollups and fingerprints against brute-force versions."""

import gzip
import hashlib
import math
import random
import re
from base64 import b32encode
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewash.llm import fingerprints, queries, topk, warc
from tablewash.llm.rollups import Rollups
from tablewash.session import scratch_path

SF = "/root/testdata/sf0.001"


# --- WARC ---------------------------------------------------------------------------------------

def expected_pages(rows, min_bytes):
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = last.get(html or "") if len(raw) >= min_bytes else None
        revisit = to is not None and page is not None and page != to
        out.append((page, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc_round_trip(spark, min_bytes):
    urls = ["http://A.example.com/x?q=1#frag", "https://a.example.com/x?q=1", None, "no url at all", "http://b.example/\r\nInjected: 1", "http://host", "http://é.fr/ü ü"]
    htmls = [None, "", "<p>same</p>", "<p>same</p>", "ab", "ab", "x" * 300_000, "ünï\r\n\r\ncode", "日本"]
    rng = random.Random(1)
    rows = [(i, rng.choice(urls), rng.choice(htmls)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(5)
    got = warc.round_trip(spark, pages, min_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_pages(rows, min_bytes)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_pages_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 8)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    folder = scratch_path(spark, "warc-test")
    places = warc.write_archives(spark, pages, f"{folder}/archives")
    shards = warc.build_index(spark, places, f"{folder}/index")
    own = warc.Index(shards, f"{folder}/index", f"{folder}/archives")
    for r in places.collect():
        (capture,) = own.find(r["key"], r["id"], r["id"])
        fields, payload = own.read(capture)
        html = next(h for p, _, h in rows if p == r["id"])
        assert fields["WARC-Type"] == "revisit" or payload.decode() == (html or "")
    assert list(own.find("zz,none)/")) == [] and list(own.find("")) == []
    url = rows[0][1]
    found = warc.captures(spark, spark.createDataFrame([(url,), (url,)], "url string"), shards, f"{folder}/index", f"{folder}/archives").collect()
    assert rows[0][0] in [r.page_id for r in found]
    # the archives are plain concatenated gzip members
    files = list(Path(f"{folder}/archives").glob("*.warc.gz"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") for f in files) == len(rows)


def test_no_ids(spark):
    pages = spark.createDataFrame([(None, "http://a/", "x"), (None, "http://a/", "x"), (3, "http://a/", "x")], "page_id long, url string, html string")
    got = [r.record_type for r in warc.round_trip(spark, pages).collect()]
    assert got == ["response"] * 3


# --- top-k --------------------------------------------------------------------------------------

def expected_top(rows, every, k):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = [math.floor(256 * float(x)) for x in v]
            clean[i] = min(own, clean.get(i, own))
    out = []
    for q in clean:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(clean[q], v)), c) for c, v in clean.items() if c != q)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed, big", [(1, 1.0), (2, 1e6), (3, 0.01)])
def test_top_k(spark, seed, big):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-big, big) for _ in range(rng.choice([6, 6, 6, 4]))]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)]  # a hot vector, queries among its copies
    rows += [(900, None), (901, [1.0, None]), (902, [math.nan]), (910, [math.inf, 1.0]), (None, [1.0]), (920, []), (0, rows[0][1]), (5, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(spark, df, every=10, k=5).collect())
    assert got == expected_top(rows, 10, 5)


def test_top_k_blocks_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in topk.top_k(spark, df, every=4, k=5, parts=3).collect()) == expected_top(exact, 4, 5)
    assert sorted(tuple(r) for r in topk.top_k(spark, df.limit(3), every=1, k=5).collect()) == expected_top(exact[:3], 1, 5)
    assert topk.top_k(spark, df.limit(0), every=1, k=5).count() == 0


# --- rollups ------------------------------------------------------------------------------------

CHANGES = "change_id string, op string, source string, lang string, version string, n_tokens long, old_tokens long"


def test_rollups_are_idempotent(spark):
    store = Rollups(spark, scratch_path(spark, "rollups-test"))
    assert store.totals().count() == 0
    first = spark.createDataFrame(
        [("a", "insert", "s", "en", "1", 5, None), ("a", "insert", "s", "en", "1", 5, None), ("b", "insert", None, "en", "1", 7, 0), (None, "insert", "s", "en", "1", 1, 0), (None, "insert", "s", "en", "1", 1, 0)],
        CHANGES,
    )
    second = spark.createDataFrame([("c", "revise", "s", "en", "1", 9, 5), ("d", "delete", None, "en", "1", 7, 0)], CHANGES)
    assert store.apply("1", first) and not store.apply("1", first)
    assert store.apply("2", second) and not store.apply("2", second)
    want = [("s", "en", "1", 3, 11)]
    assert [tuple(r) for r in store.totals().collect()] == want
    store.compact()
    assert not store.apply("2", second)
    assert [tuple(r) for r in store.totals().collect()] == want
    assert store.apply("3", spark.createDataFrame([("e", "insert", "s", "en", "2", None, None)], CHANGES))
    assert sorted(tuple(r) for r in Rollups(spark, store.folder).totals().collect()) == want + [("s", "en", "2", 1, 0)]
    assert store.apply("4", first.limit(0)) and store.committed("4")
    with pytest.raises(Exception, match="unknown operation"):
        store.apply("5", first.withColumn("op", F.lit("upsert")))
    assert not store.committed("5")
    with pytest.raises(ValueError):
        store.apply("../x", first)


def test_token_counts_of_repeated_and_missing_ids(spark, tmp_path):
    """Every row counts: NULL ids, ids repeated with other text or source, equal rows."""
    rows = [(None, "a b"), (None, "a b"), (None, "c"), (1, "x y 1"), (1, "x"), (1, "x"), (3, "q 1"), (3, "q r 2"), (7, "z"), (7, "z z")]
    docs = [(d, t, "s", "en", len(t)) for d, t in rows] + [(1, "v w", "other", "en", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, t, source, *_ in docs:
        words = len(re.findall("[A-Za-z]+", t)) if d == 3 else len(t.split())
        for version, n in (("words-1", words), ("quads-1", (len(t) + 3) // 4)):
            if d != 7:
                have = want.setdefault((source, "en", version), [0, 0])
                have[0] += 1
                have[1] += n
    got = queries.op6_token_counts(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((*k, *v) for k, v in want.items())


def test_lost_race(spark):
    """A marker made by another writer meanwhile wins; the late sums are never read."""
    store = Rollups(spark, scratch_path(spark, "rollups-race"))
    assert store._mark("commits", "1", {"path": "none"})
    assert not store._mark("commits", "1", {"path": "other"})


# --- fingerprints -------------------------------------------------------------------------------

def test_fingerprints(spark, sf_docs, odd_docs):
    docs = sf_docs.select("doc_id", "text").union(odd_docs.select((F.col("doc_id") - 100).alias("doc_id"), "text")).withColumn("d", F.lit("clash"))
    got = fingerprints.fingerprints(spark, docs.repartition(7)).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    by_id, seen = {r.doc_id: r for r in got}, {}
    prints = {r.doc_id: r.fingerprint for r in got}
    for i, (d, text) in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)], len(text)
        edited = text[: n - n // 2] + after[1][: n // 2]
        r = by_id[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if prints[after[0]] == r.fingerprint:
            assert r.near_next == 1
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.8 * len(long)
    assert fingerprints.fingerprints(spark, odd_docs.limit(0)).count() == 0


def test_order_counts(spark):
    """The same words in another order are less alike than the same order with a few words changed."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(80)}" for _ in range(600)]
    swapped = words[300:] + words[:300]
    changed = [w if rng.random() > 0.02 else "new" for w in words]
    df = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, changed, swapped, ["z"] * 50)], "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "x"), "b", "y")
    same, near, moved, other = [r[0] for r in df.select(fingerprints.likeness("x", "y")).collect()]
    assert same == 1 and other == 0 and 0.5 < near < 1 and moved < near


def test_occurrences_are_numbered_in_plain_python(spark):
    """k-mers and their occurrence numbers as a brute-force version counts them."""
    text = "a b a b a b c"
    df = fingerprints.with_fingerprint(spark.createDataFrame([(text,), ("a b c",), ("",), ("one",)], "t string"), "t", "f")
    filled = [sum(x != fingerprints.EMPTY for x in r.f) for r in df.collect()]
    kmers = defaultdict(int)
    w = text.split()
    for x in zip(w, w[1:]):
        kmers[x] += 1
    assert sum(kmers.values()) == 6 and 1 <= filled[0] <= 6 and filled[2] == 0 and filled[3] == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_have_their_sql(name):
    assert name in queries.QUERIES
