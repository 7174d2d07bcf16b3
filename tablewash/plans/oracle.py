"""DuckDB SQL that computes, from the same driver tables, what each registered
job returns. Used by the driver's correctness check and by tools/oracle_check.py.
"""

from __future__ import annotations

LINEITEM_COLS = [
    ("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True),
    ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
    ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False),
]

DUCK_TO_SPARK_TYPE = """CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int'
  WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'FLOAT' THEN 'float' WHEN data_type = 'VARCHAR' THEN 'string'
  WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type = 'DATE' THEN 'date'
  WHEN data_type LIKE 'TIMESTAMP WITH%' THEN 'timestamp' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz'
  ELSE lower(data_type) END"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_by_name(ws: str) -> dict[str, str]:
    WS = _sql_str(ws)
    out: dict[str, str] = {}

    flags_z = """SELECT '  ' || l_returnflag || chr(160) AS l_returnflag, l_linestatus, l_quantity,
               nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem"""

    out["clean_flagship"] = f"""
WITH z AS ({flags_z}),
f AS (SELECT l_returnflag, l_linestatus,
             coalesce(l_quantity, (SELECT avg(l_quantity) FROM z)) AS l_quantity,
             coalesce(l_discount, (SELECT avg(l_discount) FROM z)) AS l_discount,
             coalesce(l_tax, (SELECT avg(l_tax) FROM z)) AS l_tax FROM z),
d AS (SELECT DISTINCT * FROM f)
SELECT lower(trim(l_returnflag, {WS})) AS l_returnflag, lower(trim(l_linestatus, {WS})) AS l_linestatus,
       round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax
FROM d"""
    out["recipe_replay"] = out["clean_flagship"]
    out["recipe_run_csv"] = out["clean_flagship"]

    out["profile_snapshot"] = f"""
WITH z AS ({flags_z}),
g AS (SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM z)) AS n_distinct FROM z)
SELECT 'rows' AS metric, '*' AS column_name, n_rows AS value FROM g
UNION ALL SELECT 'columns', '*', 5 FROM g
UNION ALL SELECT 'duplicates', '*', n_rows - n_distinct FROM g
UNION ALL SELECT 'missing', 'l_returnflag', count(*) FILTER (WHERE l_returnflag IS NULL) FROM z
UNION ALL SELECT 'missing', 'l_linestatus', count(*) FILTER (WHERE l_linestatus IS NULL) FROM z
UNION ALL SELECT 'missing', 'l_quantity', count(*) FILTER (WHERE l_quantity IS NULL) FROM z
UNION ALL SELECT 'missing', 'l_discount', count(*) FILTER (WHERE l_discount IS NULL) FROM z
UNION ALL SELECT 'missing', 'l_tax', count(*) FILTER (WHERE l_tax IS NULL) FROM z"""

    missing_parts = []
    for i, (n, numeric) in enumerate(LINEITEM_COLS):
        cond = f"{n} IS NULL OR {n} = 0" if numeric else f"{n} IS NULL"
        missing_parts.append(
            f"SELECT '{n}' AS column_name, {i} AS position, count(*) FILTER (WHERE {cond}) AS missing FROM lineitem"
        )
    out["profile_missing"] = "\nUNION ALL ".join(missing_parts)

    out["profile_types"] = f"""
WITH m AS ({out["profile_missing"]}),
t AS (SELECT column_name, CAST(ordinal_position - 1 AS INTEGER) AS position, {DUCK_TO_SPARK_TYPE} AS data_type
      FROM information_schema.columns WHERE table_name = 'lineitem')
SELECT t.column_name, t.position, t.data_type, m.missing FROM t JOIN m USING (column_name, position)"""

    out["profile_duplicates"] = """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates
FROM documents"""

    out["replace_zeros_named"] = """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem"""
    out["replace_zeros_all"] = """
SELECT nullif(doc_id, 0) AS doc_id, nullif(quality, 0) AS quality, nullif(toxic, 0) AS toxic FROM labels"""
    out["drop_rows_any"] = """
SELECT * FROM (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax
               FROM lineitem) WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL"""
    # customer after zeros -> missing in every numeric column: c_custkey (key 0)
    # and c_nationkey (nation 0) hold zeros, so only the other three remain.
    out["drop_cols_any"] = "SELECT c_name, c_acctbal, c_mktsegment FROM customer"

    keyed_z = """SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
               nullif(l_returnflag, 'R') AS l_returnflag FROM lineitem"""
    out["fill_mean"] = f"""
WITH z AS ({keyed_z})
SELECT l_orderkey, l_linenumber,
       round(coalesce(l_discount, (SELECT avg(l_discount) FROM z)), 6) AS l_discount,
       round(coalesce(l_tax, (SELECT avg(l_tax) FROM z)), 6) AS l_tax, l_returnflag FROM z"""
    out["fill_median"] = f"""
WITH z AS ({keyed_z})
SELECT l_orderkey, l_linenumber,
       round(coalesce(l_discount, (SELECT median(l_discount) FROM z)), 6) AS l_discount,
       round(coalesce(l_tax, (SELECT median(l_tax) FROM z)), 6) AS l_tax, l_returnflag FROM z"""

    def mode(col: str) -> str:
        return f"(SELECT {col} FROM z WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"

    out["fill_mode"] = f"""
WITH z AS ({keyed_z})
SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, {mode('l_discount')}), 6) AS l_discount,
       round(coalesce(l_tax, {mode('l_tax')}), 6) AS l_tax, coalesce(l_returnflag, {mode('l_returnflag')}) AS l_returnflag
FROM z"""
    out["fill_literal_typed"] = """
SELECT doc_id, coalesce(nullif(quality, 0), 7) AS quality, coalesce(nullif(toxic, 0), 7) AS toxic FROM labels"""
    out["fill_literal_widen"] = """
SELECT l_orderkey, l_linenumber, coalesce(CAST(nullif(l_discount, 0) AS VARCHAR), 'missing') AS l_discount, l_tax
FROM lineitem"""

    out["dedup_rows"] = "SELECT DISTINCT text, lang FROM documents"

    out["cast_int"] = """
SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice FROM lineitem"""
    out["cast_float"] = "SELECT l_orderkey, l_linenumber, l_quantity AS qty_text FROM lineitem"
    out["cast_str"] = "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_quantity FROM lineitem"
    out["cast_datetime_text"] = """
SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders"""
    out["cast_datetime_ordered"] = """
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT day(arg_min(d, o_orderkey)) > 12 AS day_first,
  min(strftime(d, '%d/%m/%Y')) FILTER (WHERE day(d) > 12) AS not_month FROM t)
SELECT o_orderkey,
  CASE WHEN day_first THEN strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
    WHEN not_month IS NULL THEN strftime(make_timestamp(year(d), day(d), month(d), 0, 0, 0), '%Y-%m-%d %H:%M:%S')
    ELSE strftime(d, '%d/%m/%Y') END AS o_orderdate,
  CASE WHEN NOT day_first THEN not_month END AS broken_by
FROM t, f"""
    out["cast_datetime_epoch"] = """
SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events"""
    out["cast_guard_refused"] = """
SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR) AS p_size, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice
FROM part"""

    out["trim_text"] = f"""
SELECT p_partkey, trim('  ' || p_name || ' ' || chr(9), {WS}) AS p_name, trim(p_brand, {WS}) AS p_brand FROM part"""
    out["case_lower"] = "SELECT doc_id, lower(text) AS text FROM documents"
    # DuckDB upper-cases ß to ẞ where Spark and Python give SS
    out["case_upper"] = "SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS text FROM documents"
    out["case_title"] = r"""
SELECT doc_id, array_to_string(list_transform(
         regexp_extract_all(text, '([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)', 1),
         lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '') AS text
FROM documents"""

    out["sort_nulls_last"] = """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem
ORDER BY l_discount DESC NULLS LAST"""
    out["union_sheets"] = """
SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS amount, o_orderstatus AS status,
       CAST(NULL AS VARCHAR) AS flag, 'orders' AS sheet FROM orders
UNION ALL
SELECT l_orderkey, CAST(l_linenumber AS DOUBLE), CAST(NULL AS VARCHAR), l_returnflag, 'lineitem' FROM lineitem"""

    cleaned = f"""
WITH z AS ({flags_z}),
f AS (SELECT l_returnflag, l_linestatus,
             coalesce(l_quantity, (SELECT avg(l_quantity) FROM z)) AS l_quantity,
             coalesce(l_discount, (SELECT avg(l_discount) FROM z)) AS l_discount,
             coalesce(l_tax, (SELECT avg(l_tax) FROM z)) AS l_tax FROM z),
d AS (SELECT DISTINCT * FROM f),
c AS (SELECT lower(trim(l_returnflag, {WS})) AS l_returnflag, lower(trim(l_linestatus, {WS})) AS l_linestatus,
             l_quantity, l_discount, l_tax FROM d),
b AS (SELECT count(*) AS r,
             count(*) FILTER (WHERE l_discount IS NULL) + count(*) FILTER (WHERE l_tax IS NULL) AS m,
             count(*) FILTER (WHERE l_returnflag IS NULL) AS m_rf, count(*) FILTER (WHERE l_linestatus IS NULL) AS m_ls,
             count(*) FILTER (WHERE l_quantity IS NULL) AS m_q, count(*) FILTER (WHERE l_discount IS NULL) AS m_d,
             count(*) FILTER (WHERE l_tax IS NULL) AS m_t,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM z)) AS dup FROM z),
a AS (SELECT count(*) AS r,
             count(*) FILTER (WHERE l_returnflag IS NULL) + count(*) FILTER (WHERE l_linestatus IS NULL)
             + count(*) FILTER (WHERE l_quantity IS NULL) + count(*) FILTER (WHERE l_discount IS NULL)
             + count(*) FILTER (WHERE l_tax IS NULL) AS m,
             count(*) FILTER (WHERE l_returnflag IS NULL) AS m_rf, count(*) FILTER (WHERE l_linestatus IS NULL) AS m_ls,
             count(*) FILTER (WHERE l_quantity IS NULL) AS m_q, count(*) FILTER (WHERE l_discount IS NULL) AS m_d,
             count(*) FILTER (WHERE l_tax IS NULL) AS m_t,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS dup FROM c),
ty AS (SELECT column_name, {DUCK_TO_SPARK_TYPE} AS t,
              CASE column_name WHEN 'l_returnflag' THEN 1 WHEN 'l_linestatus' THEN 2 WHEN 'l_quantity' THEN 3
                               WHEN 'l_discount' THEN 4 ELSE 5 END AS pos
       FROM information_schema.columns
       WHERE table_name = 'lineitem'
         AND column_name IN ('l_returnflag', 'l_linestatus', 'l_quantity', 'l_discount', 'l_tax'))"""
    import html as _html
    import json as _json

    recipe_steps = [
        ("replace_zeros", {"columns": ["l_discount", "l_tax"]}),
        ("handle_missing", {"method": "fill", "fill_value": "mean"}),
        ("remove_duplicates", {"remove": "yes"}),
        ("trim_whitespace", {}),
        ("standardize_case", {"case": "lowercase"}),
    ]
    steps_json = _json.dumps(
        [{"step": n, "params": dict(sorted(p.items()))} for n, p in recipe_steps], ensure_ascii=False, separators=(",", ":"),
    )
    steps_html = "".join(
        f"<li>{_html.escape(n)} — {_html.escape(_json.dumps(p, ensure_ascii=False, sort_keys=True))}</li>"
        for n, p in recipe_steps
    )

    def snap(x: str) -> str:
        return (
            f"""'{{"rows":' || {x}.r || ',"columns":5,"missing_values":{{"l_returnflag":' || {x}.m_rf
            || ',"l_linestatus":' || {x}.m_ls || ',"l_quantity":' || {x}.m_q || ',"l_discount":' || {x}.m_d
            || ',"l_tax":' || {x}.m_t || '}},"duplicates":' || {x}.dup || ',"column_types":{{' || types_json.j || '}}}}'"""
        )

    out["report_json"] = cleaned + f""",
types_json AS (SELECT string_agg('"' || column_name || '":"' || t || '"', ',' ORDER BY pos) AS j FROM ty)
SELECT '{{"generated_at":"2026-01-01T00:00:00","pipeline_steps":' || {_sql_str(steps_json)} || ',"before":'
       || {snap("b")} || ',"after":' || {snap("a")}
       || ',"summary":{{"rows_removed":' || (b.r - a.r) || ',"columns_removed":0,"missing_values_before":' || b.m
       || ',"missing_values_after":' || a.m || ',"duplicates_removed":' || (b.dup - a.dup) || '}}}}' AS json
FROM a, b, types_json"""

    def row(*cells: str) -> str:
        return "'<tr>' || " + " || ".join(f"'<td>' || {x} || '</td>'" for x in cells) + " || '</tr>'"

    out["report_html"] = cleaned + f""",
types_html AS (SELECT string_agg('<tr><td>' || column_name || '</td><td>' || t || '</td></tr>', '' ORDER BY pos) AS h FROM ty)
SELECT '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10)
       || '<head><meta charset="UTF-8"><title>Cleaning report</title></head>' || chr(10) || '<body>' || chr(10)
       || '<h1>Cleaning report</h1>' || chr(10) || '<p>Generated at: 2026-01-01T00:00:00</p>' || chr(10)
       || '<h2>Summary</h2>' || chr(10) || '<table>' || chr(10)
       || '<tr><th>Metric</th><th>Before</th><th>After</th><th>Change</th></tr>'
       || {row("'Rows'", "b.r", "a.r", "'-' || (b.r - a.r)")}
       || {row("'Columns'", "5", "5", "'-0'")}
       || {row("'Missing values'", "b.m", "a.m", "'-' || (b.m - a.m)")}
       || {row("'Duplicates removed'", "''", "''", "(b.dup - a.dup)")}
       || chr(10) || '</table>' || chr(10) || '<h2>Pipeline steps</h2>' || chr(10) || '<ol>' || {_sql_str(steps_html)}
       || '</ol>' || chr(10) || '<h2>Column types after cleaning</h2>' || chr(10) || '<table>' || chr(10)
       || '<tr><th>Column</th><th>Type</th></tr>' || types_html.h || chr(10) || '</table>' || chr(10) || '</body>'
       || chr(10) || '</html>' AS html
FROM a, b, types_html"""
    out["report_before_after"] = cleaned + """
SELECT b.r AS rows_before, a.r AS rows_after, CAST(5 AS BIGINT) AS columns_before, CAST(5 AS BIGINT) AS columns_after,
       b.dup AS duplicates_before, a.dup AS duplicates_after, b.r - a.r AS rows_removed,
       CAST(0 AS BIGINT) AS columns_removed,
       b.m AS missing_values_before, a.m AS missing_values_after, b.dup - a.dup AS duplicates_removed
FROM a, b"""
    steps = [
        '  1. replace_zeros — {"columns": ["l_discount", "l_tax"]}',
        '  2. handle_missing — {"fill_value": "mean", "method": "fill"}',
        '  3. remove_duplicates — {"remove": "yes"}',
        "  4. trim_whitespace — {}",
        '  5. standardize_case — {"case": "lowercase"}',
    ]
    fixed_head = ["=== CLEANING REPORT ===", "Generated at: 2026-01-01T00:00:00", "", "--- SUMMARY ---"]
    literal = [(i, t) for i, t in enumerate(fixed_head)]
    literal += [(8, ""), (9, "--- PIPELINE STEPS ---")]
    literal += [(10 + i, t) for i, t in enumerate(steps)]
    literal += [(15, ""), (16, "--- COLUMN TYPES AFTER CLEANING ---")]
    values = ", ".join(f"({i}, {_sql_str(t)})" for i, t in literal)
    out["report_text"] = cleaned + f""",
fixed(line_no, line) AS (VALUES {values}),
types AS (SELECT CAST(16 + ordinal_position - 8 AS BIGINT) AS line_no, column_name, {DUCK_TO_SPARK_TYPE} AS t
          FROM information_schema.columns
          WHERE table_name = 'lineitem' AND column_name IN ('l_quantity', 'l_discount', 'l_tax',
                                                             'l_returnflag', 'l_linestatus'))
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM fixed
UNION ALL SELECT 4, printf('Rows:             %d → %d (-%d)', b.r, a.r, b.r - a.r) FROM a, b
UNION ALL SELECT 5, 'Columns:          5 → 5 (-0)'
UNION ALL SELECT 6, printf('Missing values:   %d → %d', b.m, a.m) FROM a, b
UNION ALL SELECT 7, printf('Duplicates removed: %d', b.dup - a.dup) FROM a, b
UNION ALL SELECT CAST(CASE column_name WHEN 'l_returnflag' THEN 17 WHEN 'l_linestatus' THEN 18
                  WHEN 'l_quantity' THEN 19 WHEN 'l_discount' THEN 20 ELSE 21 END AS INTEGER),
                 '  ' || column_name || ': ' || t FROM types"""

    out["scan_csv_roundtrip"] = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"""
    out["scan_csv_latin1"] = "SELECT doc_id, lang, text FROM documents"
    out["dedup_rows_wide"] = "SELECT DISTINCT text, lang, source, n_chars FROM documents"
    out["duplicate_count_wide"] = """
SELECT 'documents' AS table_name, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicates FROM documents
UNION ALL SELECT 'pages', count(*) - (SELECT count(*) FROM (SELECT DISTINCT url, html FROM pages)) FROM pages
UNION ALL SELECT 'conversations', count(*) - (SELECT count(*) FROM (SELECT DISTINCT role, text FROM conversations)) FROM conversations"""
    out["extract_vocab_large"] = """
WITH l AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS word, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10) AS known FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE known) AS n, coalesce(string_agg(word, ',' ORDER BY word) FILTER (WHERE known), '') AS words FROM l GROUP BY o_custkey"""
    out["scan_csv_split"] = "SELECT doc_id, text, lang FROM documents"
    out["infer_types"] = """
SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS qty,
       (l_returnflag = 'R') AS returned, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag END AS flag
FROM lineitem"""
    firsts = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"),
              ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"),
              ("lineitem", "l_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("labels", "doc_id"),
              ("conversations", "conv_id"), ("pages", "page_id"), ("benchmark", "item_id"), ("embeddings", "vec_id")]
    out["key_detect"] = "\nUNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{k}' AS column_name, count(*) AS n_rows,
       count(DISTINCT {k}) + CASE WHEN count(*) > count({k}) THEN 1 ELSE 0 END AS n_distinct,
       count(*) = count(DISTINCT {k}) + CASE WHEN count(*) > count({k}) THEN 1 ELSE 0 END AS is_key FROM {t}"""
        for t, k in firsts
    )
    out["key_promote"] = f"""
WITH z AS (SELECT c_custkey, c_name, nullif(c_nationkey, 0) AS c_nationkey, nullif(c_acctbal, 0) AS c_acctbal,
                  c_mktsegment FROM customer)
SELECT c_custkey, trim(c_name, {WS}) AS c_name,
       round(coalesce(CAST(c_nationkey AS DOUBLE), (SELECT median(c_nationkey) FROM z)), 6) AS c_nationkey,
       round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM z)), 6) AS c_acctbal,
       trim(c_mktsegment, {WS}) AS c_mktsegment
FROM z"""
    out["json_flatten"] = """
SELECT event_id, user_id AS "user.id", event_type AS "user.detail.kind", value AS "user.detail.value",
       CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events"""
    out["scan_json"] = out["json_flatten"]
    out["scan_json_document"] = out["json_flatten"]
    out["json_document_rejects"] = """
SELECT CASE WHEN event_type <> 'error' THEN 'good' ELSE 'reject' END AS kind,
       CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
       CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       CASE WHEN event_type = 'error' THEN '{"event_id":' || event_id || ',"event_type":"error","value":}' END AS record
FROM events"""
    out["json_rejects"] = """
SELECT CASE WHEN event_type <> 'error' THEN 'good' ELSE 'reject' END AS kind,
       CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
       CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       CASE WHEN event_type = 'error' THEN '{"event_id":' || event_id || ',"event_type":"error","value":' END AS record
FROM events"""
    out["scan_xlsx"] = """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice, 'part' AS sheet FROM part"""
    out["vocabulary_clean"] = """
SELECT * FROM (SELECT p_name AS name, nullif(p_brand, 'Brand#1') AS code, nullif(p_type, 'ECONOMY') AS code_base
               FROM part)
WHERE name IS NOT NULL AND code IS NOT NULL AND code_base IS NOT NULL"""
    out["export_csv_roundtrip"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, nullif(l_discount, 0) AS l_discount, l_tax
FROM lineitem"""
    out["export_parquet_roundtrip"] = out["replace_zeros_named"]
    out["export_table_replace"] = out["replace_zeros_named"]
    out["export_documents"] = "SELECT doc_id, quality, toxic FROM labels"

    # Census of files written from nation (CSV), region (JSON), supplier (Parquet)
    # and region as JSON text under .csv names: the outcome depends only on the
    # formats written (ASCII names, binary Parquet), one row per outcome.
    out["file_census"] = """
SELECT * FROM (VALUES
  ('csv', '.csv', 'csv', 'csv', 'UTF-8', 'ok'),
  ('json', '.json', 'json', 'json', 'UTF-8', 'ok'),
  ('parquet', '.parquet', 'format not supported yet', 'csv', 'ISO-8859-1', 'unsupported'),
  ('fake', '.csv', 'csv', 'json', 'UTF-8', 'mismatch')
) AS t(folder, extension, ext_type, content_type, encoding, status)"""
    out["file_encoding"] = r"""
WITH d AS (SELECT DISTINCT CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'true' ELSE 'false' END AS non_ascii
           FROM documents),
f(folder) AS (VALUES ('utf8'), ('latin1'))
SELECT folder, non_ascii, 'csv' AS ext_type, 'csv' AS content_type,
       CASE WHEN folder = 'latin1' AND non_ascii = 'true' THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding,
       'ok' AS status
FROM f, d"""
    out.update(_extraction_sql(WS))
    return out


def _extraction_sql(WS: str) -> dict[str, str]:
    from tablewash.plans.extract import DEFAULT_TEMPLATE, RULE_CATEGORIES
    from tablewash.sources.vocabulary import CATEGORIES

    out: dict[str, str] = {}

    def cat_case(expr: str, cats) -> str:
        whens = []
        for i, raw in enumerate(cats):
            low = raw.strip().lower()
            val = low.capitalize() if low in CATEGORIES else "unknown"
            whens.append(f"WHEN {i} THEN '{val}'")
        return f"CASE {expr} % {len(cats)} " + " ".join(whens) + " END"

    notes = """
n AS (SELECT role AS sheet, conv_id, turn, text,
             CASE WHEN turn < 2 THEN NULL ELSE 'P' || CAST(conv_id AS VARCHAR) END AS pid,
             CAST(conv_id AS VARCHAR) AS session FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY conv_id, turn) AS row_ordinal FROM n),
pat AS (SELECT sheet, coalesce(min_by(pid, conv_id * 1000000 + turn) FILTER (WHERE pid IS NOT NULL), 'unknown')
               AS patient_id FROM n GROUP BY sheet),
notes AS (SELECT o.*, pat.patient_id, length(text) % 6 AS v FROM o JOIN pat USING (sheet)
          WHERE lower(text) NOT IN ('', 'nan', 'none'))"""

    out["extract_session_fallback"] = f"""
WITH {notes}
SELECT sheet, 'session_' || CAST(row_ordinal AS VARCHAR) AS session, row_ordinal FROM notes"""
    out["extract_patient"] = f"WITH {notes}\nSELECT DISTINCT sheet, patient_id FROM notes"
    out["extract_skip_empty"] = """
WITH n AS (SELECT role AS sheet, conv_id, turn, CAST(conv_id AS VARCHAR) AS session,
                  CASE WHEN turn = 1 THEN '' WHEN turn = 3 THEN 'None' WHEN turn = 5 THEN 'NaN'
                       WHEN turn = 2 THEN '  ' ELSE text END AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY conv_id, turn) AS row_ordinal FROM n)
SELECT sheet, session, row_ordinal, text FROM o WHERE lower(text) NOT IN ('', 'nan', 'none')"""
    out["extract_score_retry"] = f"""
WITH {notes}
SELECT CASE v WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS attempt, count(*) AS notes FROM notes GROUP BY 1"""

    cats_list = "[" + ", ".join(f"'{x}'" for x in CATEGORIES) + "]"
    pre, rest = DEFAULT_TEMPLATE.split("{text}", 1)
    a, rest = rest.split("{reference}", 1)
    b, rest = rest.split("{vocabulary}", 1)
    c = rest.format(categories=", ".join(x.capitalize() for x in CATEGORIES))
    out["extract_prompt"] = f"""
WITH {notes},
ref AS (SELECT string_agg(l, chr(10) ORDER BY l) AS t
        FROM (SELECT '- ' || r_name || ' | code: ' || upper(substr(r_name, 1, 3)) || ' | code_base: '
                     || {cats_list}[r_regionkey % {len(CATEGORIES)} + 1] AS l FROM region)),
voc AS (SELECT string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS t FROM (SELECT DISTINCT n_name FROM nation))
SELECT sheet, session, row_ordinal,
       {_sql_str(pre)} || text || {_sql_str(a)} || ref.t || {_sql_str(b)} || voc.t || {_sql_str(c)} AS prompt
FROM notes, ref, voc"""

    out["extract_flagship"] = f"""
WITH {notes},
voc AS (SELECT list(n_name ORDER BY n_name) AS a, count(*) AS k FROM (SELECT DISTINCT n_name FROM nation)),
lines AS (SELECT notes.*, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS j
          FROM notes WHERE v <> 5),
recs AS (SELECT *, row_number() OVER (PARTITION BY sheet, conv_id, turn ORDER BY j) - 1 AS pos
         FROM lines WHERE trim(line, {WS}) <> ''),
r AS (
  SELECT patient_id, session, sheet, row_ordinal, pos, trim(line, {WS}) AS exercise_name,
         substr(trim(line, {WS}), 1, 3) AS code,
         {cat_case("length(line)", RULE_CATEGORIES)} AS code_base,
         voc.a[length(line) % voc.k + 1] || ', ' || voc.a[(length(line) * 7 + 3) % voc.k + 1] AS muscles,
         CASE WHEN j % 3 = 2 THEN 'parallel bars' END AS assistance,
         CASE WHEN length(line) % 5 = 0 THEN NULL ELSE CAST(length(line) % 5 AS VARCHAR) END AS repetitions,
         CASE WHEN j = 0 THEN NULL ELSE CAST(j * 15 AS VARCHAR) END AS time
  FROM recs, voc
  UNION ALL
  SELECT patient_id, session, sheet, row_ordinal, 0, 'unknown', 'UNK', 'unknown', '', NULL, NULL, NULL
  FROM notes WHERE v = 5)
SELECT patient_id, session,
       CAST(row_number() OVER (PARTITION BY sheet, session ORDER BY row_ordinal, pos) AS INTEGER) AS exercise_num,
       exercise_name, code, code_base, muscles, assistance, repetitions, time
FROM r"""

    out["extract_parse"] = f"""
WITH nat AS (SELECT list(n_name ORDER BY n_nationkey) AS names, count(*) AS k FROM nation),
base AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_partkey % 8 AS v,
         {cat_case("p_size", RULE_CATEGORIES)} AS cb,
         nat.names[p_size % nat.k + 1] AS m1,
         CASE WHEN p_size % 3 = 2 THEN 'bars' END AS asst,
         CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 4 AS VARCHAR) END AS reps,
         CASE WHEN p_size % 2 = 0 THEN NULL ELSE '12.5' END AS tm
  FROM part, nat)
SELECT p_partkey, 0 AS pos, p_name AS exercise_name, p_brand AS code, cb AS code_base, m1 AS muscles,
       asst AS assistance, reps AS repetitions, tm AS time FROM base WHERE v IN (0, 1, 2, 3, 5)
UNION ALL SELECT p_partkey, 1, p_type, 'T2', cb, m1, asst, reps, tm FROM base WHERE v = 2
UNION ALL SELECT p_partkey, 0, 'unknown', 'UNK', 'unknown', '', NULL, NULL, NULL FROM base WHERE v IN (4, 7)"""

    part_base = f"""
WITH nat AS (SELECT list(n_name ORDER BY n_nationkey) AS names, count(*) AS k FROM nation),
base AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_partkey % 8 AS v,
         {cat_case("p_size", RULE_CATEGORIES)} AS cb,
         nat.names[p_size % nat.k + 1] AS m1,
         CASE WHEN p_size % 3 = 2 THEN 'bars' END AS asst,
         CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 4 AS VARCHAR) END AS reps,
         CASE WHEN p_size % 2 = 0 THEN NULL ELSE '12.5' END AS tm
  FROM part, nat),
recs AS (
  SELECT p_partkey, 0 AS pos, cb, m1, asst, reps, tm FROM base WHERE v IN (0, 1, 2, 3, 5)
  UNION ALL SELECT p_partkey, 1, cb, m1, asst, reps, tm FROM base WHERE v = 2)"""
    out["extract_parse_strict"] = "SELECT p_partkey, (p_partkey % 8) IN (0, 1, 2, 3, 5, 6) AS parsed_ok FROM part"
    out["extract_validate"] = part_base + """
SELECT p_partkey, pos, cb AS code_base, asst AS assistance, reps AS repetitions, tm AS time FROM recs"""
    out["extract_vocab_filter"] = part_base + """
SELECT p_partkey, pos, m1 AS muscles, 1 AS n_muscles FROM recs"""
    out["extract_fallback"] = """
SELECT p_partkey, 'unknown' AS exercise_name, 'UNK' AS code, 'unknown' AS code_base, '' AS muscles,
       CAST(NULL AS VARCHAR) AS assistance, CAST(NULL AS VARCHAR) AS repetitions, CAST(NULL AS VARCHAR) AS time
FROM part WHERE p_partkey % 8 IN (4, 7)"""
    out["extract_explode"] = """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 8 = 2 THEN 2 ELSE 1 END AS BIGINT) AS n_records,
       CASE WHEN p_partkey % 8 = 2 THEN 1 ELSE 0 END AS last_pos
FROM part WHERE p_partkey % 8 <> 6"""
    out["extract_number"] = f"""
WITH {notes},
lines AS (SELECT notes.*, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS j
          FROM notes WHERE v <> 5),
recs AS (SELECT sheet, session, row_ordinal,
                CAST(row_number() OVER (PARTITION BY sheet, conv_id, turn ORDER BY j) - 1 AS INTEGER) AS pos
         FROM lines WHERE trim(line, {WS}) <> ''),
r AS (SELECT sheet, session, row_ordinal, pos FROM recs
      UNION ALL SELECT sheet, session, row_ordinal, 0 FROM notes WHERE v = 5)
SELECT sheet, session, row_ordinal, pos,
       row_number() OVER (PARTITION BY sheet, session ORDER BY row_ordinal, pos) AS exercise_num
FROM r"""
    out["extract_roles"] = """
SELECT 'session' AS role, 'Seance' AS column_name, count(conv_id) AS non_missing FROM conversations
UNION ALL SELECT 'patient', 'Patient_ID', count(*) FILTER (WHERE turn >= 2) FROM conversations
UNION ALL SELECT 'text', 'Notes', count(text) FROM conversations"""

    whole_file_notes = """
n AS (SELECT '' AS sheet, conv_id, turn, text,
             CASE WHEN turn < 2 THEN NULL ELSE 'P' || CAST(conv_id AS VARCHAR) END AS pid,
             CAST(conv_id AS VARCHAR) AS session FROM conversations),
o AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS row_ordinal FROM n),
pat AS (SELECT coalesce(min_by(pid, conv_id * 1000000 + turn) FILTER (WHERE pid IS NOT NULL), 'unknown')
               AS patient_id FROM n),
notes AS (SELECT o.*, pat.patient_id, length(text) % 6 AS v FROM o, pat
          WHERE lower(text) NOT IN ('', 'nan', 'none'))"""
    out["analyze_csv"] = out["extract_flagship"].replace(notes, whole_file_notes, 1)
    out["analyze_xlsx"] = out["extract_reply_store"] = out["extract_flagship"]
    per_sheet_notes = """
n AS (SELECT conv_id // 40 AS book, (conv_id // 40) % 3 AS layout, role, (conv_id // 40) || '/' || role AS sheet, conv_id, turn, text,
             CASE WHEN turn < 2 THEN NULL ELSE 'P' || CAST(conv_id AS VARCHAR) END AS pid FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY conv_id, turn) AS row_ordinal FROM n),
-- layout 0: patient_id; 1: none, the sheet's name; 2: code_patient comes before id
pat AS (SELECT sheet, CASE WHEN layout = 1 THEN role ELSE coalesce(min_by(pid, conv_id * 1000000 + turn) FILTER (WHERE pid IS NOT NULL), 'unknown') END
               AS patient_id FROM n GROUP BY sheet, layout, role),
notes AS (SELECT o.*, pat.patient_id, length(text) % 6 AS v,
                 CASE layout WHEN 0 THEN CAST(conv_id AS VARCHAR) WHEN 1 THEN 'session_' || CAST(row_ordinal AS VARCHAR) ELSE CAST(turn AS VARCHAR) END AS session
          FROM o JOIN pat USING (sheet) WHERE lower(text) NOT IN ('', 'nan', 'none'))"""
    out["analyze_xlsx_sheets"] = out["extract_flagship"].replace(notes, per_sheet_notes, 1)
    assert len({out[x] for x in ("extract_flagship", "analyze_csv", "analyze_xlsx_sheets")}) == 3
    return out
