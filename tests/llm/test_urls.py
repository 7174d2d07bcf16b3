"""URL filter against a plain loop over all rules, and its edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewash.llm import queries, urls

SF = "/root/testdata/sf0.001"


def brute_force(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
    best = None
    for h, p, action in rules:
        h, p = "".join(x.lower() if "A" <= x <= "Z" else x for x in h or ""), p or ""
        if h and action and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), action, h + p))
    return host, path, best and best[3], best[2] if best else default


def judged(spark, texts, rules, **options):
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    out = urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"), **options)
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(out.collect(), key=lambda r: r.page_id)]


@pytest.mark.parametrize("limit", [urls.BROADCAST_BYTES, 0])
def test_random_urls(spark, limit):
    rng = random.Random(5)
    hosts = [".".join(rng.choices(["a", "b", "net", "org", ""], k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/", "/ab/", "//", "/a//b", "abc"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(80)]
    rules += [(None, "/", "block"), ("net", None, "block"), ("a.b", "/", None), ("B.Net", "/A/", "block"), ("", "/", "block")]
    texts = [f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/a/', '#x/', 'x', '/y'])}" for _ in range(400)]
    got = judged(spark, texts, rules, broadcast_bytes=limit)
    want = [brute_force(x, rules) for x in texts]
    assert got == want
    assert len({w[2] for w in want}) > 20


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow")]
    long = "http://" + "a." * 5000 + "net/" + "x/" * 5000
    texts = [None, "", "net/", "://", "://net/", "http://NET/", "http://net", "http://net?/", "http://xnet/", "http://u@net:80/", "http://é.net/en/", "x\ny://example.net/en/\n?", "a://b://net/", long]
    got = judged(spark, texts, rules)
    assert got == [brute_force(x, rules) for x in texts]
    assert [g[3] for g in got[:8]] == ["allow", "allow", "allow", "allow", "block", "block", "allow", "allow"]
    assert judged(spark, texts, [], default="block") == [brute_force(x, [], "block") for x in texts]
    assert judged(spark, [], rules) == []
    # equal rules: block wins; equal lengths: the longer host
    tie = [("net", "/", "allow"), ("net", "/", "block"), ("b.net", "/a", "allow"), ("net", "/a/b", "block")]
    assert [x[2:] for x in judged(spark, ["http://net/x", "http://b.net/a/b"], tie)] == [("net/", "block"), ("b.net/a", "allow")]


def test_prefixes_collide(spark, monkeypatch):
    """Short prefixes of one digit: only full digests tell the rules apart."""
    monkeypatch.setattr(urls, "PREFIX", 1)
    rules = [(f"h{i}.net", "/", "block") for i in range(40)]
    texts = [f"http://h{i}.net/" for i in range(80)]
    assert judged(spark, texts, rules) == [brute_force(x, rules) for x in texts]


def test_other_columns_and_repeated_rows(spark):
    names = ["host", "path", "rule", "verdict", "prefix", "digest", "rank", "best", "own_url", "x0", "n", "a.b", "c`d"]
    rows = spark.range(6).select(F.when(F.col("id") > 1, F.col("id") % 2).alias("page_id"), F.lit("http://net/").alias("url"), *[F.lit(f"{n}!").alias(n) for n in names])
    out = urls.judge_urls(rows, spark.createDataFrame([("net", "/", "block")], "host string, path string, action string"))
    assert out.columns == ["page_id", "url", *names[4:], "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == 6 and all(r[n] == f"{n}!" for r in got for n in names[4:])
    assert all((r.host, r.path, r.rule, r.verdict) == ("net", "/", "net/", "block") for r in got)


def test_no_python_in_the_plan(spark):
    plan = queries.op11_urls(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
