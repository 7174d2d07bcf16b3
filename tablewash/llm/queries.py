"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.llm import encoding, fingerprints, infill, lines, near, packing, quality, ranking, topk, toxicity, urls, warc
from tablewash.llm.rollups import Rollups
from tablewash.llm.common import documents, remainder, stored, table
from tablewash.session import scratch_path


def _judged(docs: DataFrame, held_out) -> DataFrame:
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return _judged(toxicity.score(spark, docs, field), remainder("doc_id", 3) == 1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(spark, documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encoding.encode(spark, documents(spark, sf_dir), path, decoded=True)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: counts by words come in; counts by bytes come in; the
    word counts of a part are revised to letters only; a part is deleted. Each batch arrives twice.
    Each row is a document: rows with a NULL or repeated doc_id count one by one, and a NULL id is
    in no part (neither revised nor deleted)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", "lang",
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.regexp_count(text, F.lit(r"[A-Za-z]+")).cast("long").alias("letters"),
        F.expr("cast((octet_length(coalesce(text, '')) + 3) div 4 as bigint)").alias("quads"),
        F.pmod("doc_id", F.lit(10)).alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    docs = stored(spark, docs, "token-counts")
    revised = F.col("part") == 3

    def changes(rows: DataFrame, op: str, version: str, n, old=F.lit(0)) -> DataFrame:
        key = F.concat_ws("/", F.lit(op), F.lit(version), "row")
        return rows.select(key.alias("change_id"), F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), n.alias("n_tokens"), old.alias("old_tokens"))

    gone = docs.where("part = 7")
    batches = {
        "0001-words": changes(docs, "insert", "words-1", F.col("words")),
        "0002-quads": changes(docs, "insert", "quads-1", F.col("quads")),
        "0003-revised": changes(docs.where(revised), "revise", "words-1", F.col("letters"), F.col("words")),
        "0004-deleted": changes(gone, "delete", "words-1", F.col("words")).union(changes(gone, "delete", "quads-1", F.col("quads"))),
    }
    store = Rollups(spark, scratch_path(spark, "rollups"))
    for name, batch in [*batches.items(), *batches.items()]:
        store.apply(name, batch)
    return store.totals()


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return _judged(toxicity.score(spark, docs, model), remainder("doc_id", 5) == 0)


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(spark, documents(spark, sf_dir), k=4, percent=85)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(spark, documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


#: Rules of the url filter, as SQL rows (host, path, action).
URL_RULES = "('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS t(host, path, action)")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=50)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.infill(spark, documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    back = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_lines": op3_lines,
    "op4_bpe": op4_bpe,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_near": op9_near,
    "op10_fingerprints": op10_fingerprints,
    "op11_urls": op11_urls,
    "op12_ranking": op12_ranking,
    "op13_infill": op13_infill,
}

SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + (k // 4) * 5 AS INT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN m ON p.html = m.html""",
    "op3_lines": r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '\S+')) AS words FROM t, range(1, len(ls) + 1) r(i)),
b AS (SELECT doc_id, i, line, words, row_number() OVER w AS p, sum(words) OVER w AS total
      FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, list(line ORDER BY p) AS ls, list(i ORDER BY p) AS ii FROM b GROUP BY doc_id),
e AS (SELECT x.doc_id, x.p, x.i AS start, min(y.p) AS e FROM b x JOIN b y
      ON x.doc_id = y.doc_id AND y.p >= x.p AND y.total - x.total + x.words >= 30 GROUP BY x.doc_id, x.p, x.i),
k AS (SELECT e.doc_id, start, ii[e.e] AS stop, list_slice(ls, e.p, e.e) AS key FROM e JOIN g USING (doc_id)),
f AS (SELECT key, doc_id AS fd, stop AS fs FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, start) AS n FROM k) WHERE n = 1),
x AS (SELECT DISTINCT l.doc_id, l.i FROM k JOIN f USING (key) JOIN l ON l.doc_id = k.doc_id AND l.i BETWEEN start AND stop
      WHERE k.doc_id <> fd OR start > fs)
SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS n_deleted,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id""",
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op6_token_counts": r"""
WITH d AS (SELECT source, lang, doc_id % 10 AS part,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS letters,
  (octet_length(encode(coalesce(text, ''))) + 3) // 4 AS quads FROM documents),
c AS (SELECT source, lang, 'words-1' AS version, CASE WHEN part = 3 THEN letters ELSE words END AS n FROM d WHERE part <> 7
  UNION ALL SELECT source, lang, 'quads-1', quads FROM d WHERE part <> 7)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY source, lang, version""",
    "op9_near": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS x FROM t, range(1, greatest(len(w) - 3, 1) + 1) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(min(reach.b), t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN reach ON reach.a = t.doc_id GROUP BY t.doc_id, n.n""",
    "op11_urls": rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM pages),
r(h, s, action) AS (VALUES {URL_RULES}),
f AS (SELECT n, h || s AS rule, action, row_number() OVER (PARTITION BY n ORDER BY length(h || s) DESC, length(h) DESC, action DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON p.n = f.n AND k = 1""",
    "op12_ranking": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u FROM documents),
x AS (SELECT d, doc_id, len(u) AS n, u FROM t WHERE len(u) > 0),
z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM x),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(u) AS term FROM x) WHERE term IN (SELECT term FROM q) GROUP BY d, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
c AS (SELECT p.d, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS s FROM p JOIN w ON p.term = w.term JOIN x ON x.d = p.d, z),
s AS (SELECT item_id, d, CAST(sum(s) AS BIGINT) AS score FROM q JOIN c ON q.term = c.term GROUP BY item_id, d),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN x ON x.d = s.d WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_infill": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS pre,
  array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS mid, array_to_string(list_slice(u, greatest(c1, c2) + 1, n), '') AS suf FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
}
