"""URL filter: host-suffix and path-prefix expressions, short hash prefixes, full digests, in DataFrame functions only.

A rule is a host, a path and an action. It fits the urls of its host and of all subdomains whose path
starts with the rule's path; of the rules that fit, the longest (characters of host and path) wins, then
the one with the longer host, then block before allow.

1. A rule is filed under one expression: its host and its path up to the last slash (a rule path such as
   ``/en`` is filed under ``/`` and fits ``/english`` too). The expression's SHA-256 is its digest,
   the first ``PREFIX`` hex digits of it the short prefix that rules and urls meet by.
2. Distinct urls are expanded into the expressions that any rule could be filed under: host suffixes of as
   many labels as some rule host has, times path prefixes of as many slashes as some rule path has. These
   two numbers come from the rules, so an endless url gives no more expressions than any other, and none
   that a rule has is left out.
3. Expressions and rules are joined on the short prefix. Prefixes collide, so the full digest and the
   rest of the rule's path are confirmed; the strongest rule of each url is one partial aggregate.
4. Rows get their url's rule back by a left join on the url; ``html`` and other columns don't pass
   through the steps above.

Rules of at most ``BROADCAST_BYTES`` are broadcast (their size is summed first). Larger rule sets are
copied ``SALTS`` times and joined on (prefix, salt), so an expression that a third of all urls share is
dealt to that many tasks.

Results: a NULL url or one without ``://`` has an empty host and path, fits no rule and gets the
default verdict, as does a url with an empty host; only A-Z are lower-cased; user names and ports belong to the
host text; an empty path does not start with ``/``. Repeated rows and NULL ids pass row by row. Rules
with a NULL host or action are left out, a NULL path is an empty one; of equal rules block wins. Columns of
``pages`` named host, path, rule or verdict are replaced, all others pass. No pages: no rows; no
rules: the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewash.functions.names import c

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the short prefix (4 bytes).
PREFIX = 8
#: Largest rule set that is broadcast, in bytes of its texts.
BROADCAST_BYTES = 32 << 20
#: Copies of a larger rule set.
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; '' without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _upto(path: Column, n: Column) -> Column:
    """``path`` up to its n-th slash, with it ('' for 0)."""
    return F.when(n == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))


def filed(rules: DataFrame) -> DataFrame:
    """Distinct rules with their expression's digest and short prefix."""
    path = F.coalesce(F.col("path"), F.lit(""))
    own = rules.where("host is not null and host != '' and action in ('allow', 'block')").select(F.translate("host", UPPER, LOWER).alias("host"), path.alias("path"), "action")
    own = own.groupBy("host", "path").agg(F.max("action").alias("action"))  # block after allow
    digest = F.sha2(F.concat("host", _upto(F.col("path"), _slashes(F.col("path")))), 256)
    rank = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("hosts"), F.col("action"), F.concat("host", "path").alias("rule"))
    return own.select(digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("prefix"), F.col("path").alias("rule_path"), rank.alias("rank"))


def expressions(urls: DataFrame, labels: int, slashes: int) -> DataFrame:
    """``url, path, digest, prefix`` of each host suffix of up to ``labels`` labels and path prefix of up
    to ``slashes`` slashes; ``urls``: url, host, path."""
    parts = F.split("host", r"\.", -1)
    suffix = F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))))
    depth = F.explode(F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(slashes))))
    wide = urls.where("host != ''").select("url", "host", "path", suffix.alias("k")).select("url", "host", "path", "k", depth.alias("d"))
    host = F.array_join(F.slice(parts, -F.col("k"), F.col("k")), ".")
    digest = F.sha2(F.concat(host, _upto(F.col("path"), F.col("d"))), 256)
    return wide.select("url", "path", digest.alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, verdict``; ``rules``: host, path, action."""
    text = c(url).cast("string")
    known = filed(rules)
    labels = F.max(F.size(F.split("host", r"\.", -1)))
    slashes = F.max(_slashes(F.coalesce(F.col("path"), F.lit(""))))
    size = F.sum(F.octet_length(F.concat("host", F.coalesce(F.col("path"), F.lit("")))) + 128)
    most, deepest, total = rules.where("host is not null").agg(labels, slashes, size).first()

    urls = pages.select(text.alias("url")).where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cut = expressions(urls, most or 0, deepest or 0) if most else expressions(urls.limit(0), 1, 0)
    if (total or 0) <= broadcast_bytes:
        met = cut.join(F.broadcast(known), "prefix")
    else:
        copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = cut.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(copies, ["prefix", "salt"])
    fits = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    best = fits.groupBy("url").agg(F.max("rank").alias("best"))

    names = [x for x in pages.columns if x not in ("host", "path", "rule", "verdict")]
    inner = {f"x{i}": x for i, x in enumerate(names)}
    rows = pages.select(*(c(x).alias(k) for k, x in inner.items()), text.alias("own_url"))
    joined = rows.join(best.withColumnRenamed("url", "judged_url"), F.col("own_url") == F.col("judged_url"), "left")
    return joined.select(
        *inner, host_of(F.col("own_url")), path_of(F.col("own_url")), F.col("best.rule"), F.coalesce("best.action", F.lit(default))
    ).toDF(*names, "host", "path", "rule", "verdict")
