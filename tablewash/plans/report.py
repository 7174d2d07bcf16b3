"""Before/after cleaning report.

Both snapshots come from ``profile_table`` (one aggregate each); they are
one-row DataFrames, so combining them is a cross join of two single rows. The
report is a one-row DataFrame with nested structs; the JSON, text and HTML
renderings are column expressions over it, so nothing goes through the driver
but the final few lines.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from tablewash.operators.profile import profile_table
from tablewash.plans.recipe import Recipe

SUMMARY_FIELDS = ("rows_removed", "columns_removed", "missing_values_before", "missing_values_after", "duplicates_removed")

# Text report layout (fixed values): headings and line formats, in report order.
TEXT_TITLE = "=== CLEANING REPORT ==="
TEXT_GENERATED = "Generated at: "
TEXT_SUMMARY = "--- SUMMARY ---"
TEXT_ROWS = "Rows:             %d → %d (-%d)"
TEXT_COLUMNS = "Columns:          %d → %d (-%d)"
TEXT_MISSING = "Missing values:   %d → %d"
TEXT_DUPLICATES = "Duplicates removed: %d"
TEXT_STEPS = "--- PIPELINE STEPS ---"
TEXT_STEP = "  %d. %s — %s"
TEXT_TYPES = "--- COLUMN TYPES AFTER CLEANING ---"
TEXT_TYPE = "  %s: %s"


def _snapshot_struct(df: DataFrame, prefix: str, approx_duplicates: bool = False) -> DataFrame:
    fields = df.schema.fields
    p = profile_table(df, approx_duplicates)
    names = F.array(*[F.lit(f.name) for f in fields]) if fields else F.array().cast("array<string>")
    miss = F.array(*[F.col(f"m_{i}") for i in range(len(fields))]) if fields else F.array().cast("array<bigint>")
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields]) if fields else F.array().cast("array<string>")
    total = F.aggregate(miss, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return p.select(
        F.struct(
            F.col("n_rows").alias("rows"),
            F.lit(len(fields)).cast("bigint").alias("columns"),
            F.map_from_arrays(names, miss).alias("missing_values"),
            F.col("duplicates").alias("duplicates"),
            F.map_from_arrays(names, types).alias("column_types"),
            total.alias("missing_total"),
        ).alias(prefix)
    )


def _steps_column(recipe: Recipe | None) -> Column:
    steps = recipe.steps if recipe else ()
    if not steps:
        return F.array().cast("array<struct<step:string,params:string>>")
    return F.array(
        *[
            F.struct(F.lit(s.step).alias("step"), F.lit(json.dumps(s.params, ensure_ascii=False, sort_keys=True)).alias("params"))
            for s in steps
        ]
    )


def build_report(before: DataFrame, after: DataFrame, recipe: Recipe | None, generated_at: str,
                 approx_duplicates: bool = False) -> DataFrame:
    """One row: generated_at, pipeline_steps, before, after, summary.
    ``approx_duplicates``: see ``profile_table`` (one pass, no row shuffle)."""
    b = _snapshot_struct(before, "before", approx_duplicates)
    a = _snapshot_struct(after, "after", approx_duplicates)
    both = b.crossJoin(F.broadcast(a))  # 1 row x 1 row
    summary = F.struct(
        (F.col("before.rows") - F.col("after.rows")).alias("rows_removed"),
        (F.col("before.columns") - F.col("after.columns")).alias("columns_removed"),
        F.col("before.missing_total").alias("missing_values_before"),
        F.col("after.missing_total").alias("missing_values_after"),
        (F.col("before.duplicates") - F.col("after.duplicates")).alias("duplicates_removed"),
    )
    return both.select(
        F.lit(generated_at).alias("generated_at"),
        _steps_column(recipe).alias("pipeline_steps"),
        F.col("before").dropFields("missing_total").alias("before"),
        F.col("after").dropFields("missing_total").alias("after"),
        summary.alias("summary"),
    )


def summary_row(report: DataFrame) -> DataFrame:
    """Flat one-row view of the report numbers."""
    return report.select(
        F.col("before.rows").alias("rows_before"),
        F.col("after.rows").alias("rows_after"),
        F.col("before.columns").alias("columns_before"),
        F.col("after.columns").alias("columns_after"),
        F.col("before.duplicates").alias("duplicates_before"),
        F.col("after.duplicates").alias("duplicates_after"),
        *[F.col(f"summary.{n}").alias(n) for n in SUMMARY_FIELDS],
    )


def report_json(report: DataFrame) -> DataFrame:
    """One row, column ``json``: the whole report as a JSON document (step parameters as objects)."""
    steps = F.transform("pipeline_steps", lambda s: F.struct(s["step"].alias("step"), F.parse_json(s["params"]).alias("params")))
    return report.withColumn("pipeline_steps", steps).select(F.to_json(F.struct("*")).alias("json"))


def report_text_lines(report: DataFrame) -> DataFrame:
    """(line_no, line): the plain-text report, one row per line."""
    s = "summary"
    lines = F.concat(
        F.array(
            F.lit(TEXT_TITLE),
            F.concat(F.lit(TEXT_GENERATED), F.col("generated_at")),
            F.lit(""),
            F.lit(TEXT_SUMMARY),
            F.format_string(TEXT_ROWS, F.col("before.rows"), F.col("after.rows"), F.col(f"{s}.rows_removed")),
            F.format_string(TEXT_COLUMNS, F.col("before.columns"), F.col("after.columns"), F.col(f"{s}.columns_removed")),
            F.format_string(TEXT_MISSING, F.col(f"{s}.missing_values_before"), F.col(f"{s}.missing_values_after")),
            F.format_string(TEXT_DUPLICATES, F.col(f"{s}.duplicates_removed")),
            F.lit(""),
            F.lit(TEXT_STEPS),
        ),
        F.transform(F.col("pipeline_steps"), lambda st, i: F.format_string(TEXT_STEP, i + 1, st["step"], st["params"])),
        F.array(F.lit(""), F.lit(TEXT_TYPES)),
        F.transform(F.map_entries(F.col("after.column_types")), lambda e: F.format_string(TEXT_TYPE, e["key"], e["value"])),
    )
    return report.select(F.posexplode(lines).alias("line_no", "line"))


def _esc(col: Column) -> Column:
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def report_html(report: DataFrame) -> DataFrame:
    """One row, column ``html``: summary table, step list, type table; values escaped."""
    s = "summary"
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _esc(x.cast("string")), F.lit("</td>")) for x in cells], F.lit("</tr>"))
    steps = F.array_join(
        F.transform(F.col("pipeline_steps"), lambda st: F.concat(F.lit("<li>"), _esc(st["step"]), F.lit(" — "), _esc(st["params"]), F.lit("</li>"))),
        "",
    )
    types = F.array_join(
        F.transform(F.map_entries(F.col("after.column_types")), lambda e: row(e["key"], e["value"])),
        "",
    )
    html = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8"><title>Cleaning report</title></head>\n<body>\n'),
        F.lit("<h1>Cleaning report</h1>\n<p>Generated at: "), _esc(F.col("generated_at")), F.lit("</p>\n"),
        F.lit("<h2>Summary</h2>\n<table>\n<tr><th>Metric</th><th>Before</th><th>After</th><th>Change</th></tr>"),
        row(F.lit("Rows"), F.col("before.rows"), F.col("after.rows"), F.concat(F.lit("-"), F.col(f"{s}.rows_removed").cast("string"))),
        row(F.lit("Columns"), F.col("before.columns"), F.col("after.columns"), F.concat(F.lit("-"), F.col(f"{s}.columns_removed").cast("string"))),
        row(
            F.lit("Missing values"), F.col(f"{s}.missing_values_before"), F.col(f"{s}.missing_values_after"),
            F.concat(F.lit("-"), (F.col(f"{s}.missing_values_before") - F.col(f"{s}.missing_values_after")).cast("string")),
        ),
        row(F.lit("Duplicates removed"), F.lit(""), F.lit(""), F.col(f"{s}.duplicates_removed")),
        F.lit("\n</table>\n<h2>Pipeline steps</h2>\n<ol>"), steps, F.lit("</ol>\n"),
        F.lit("<h2>Column types after cleaning</h2>\n<table>\n<tr><th>Column</th><th>Type</th></tr>"), types,
        F.lit("\n</table>\n</body>\n</html>"),
    )
    return report.select(html.alias("html"))


def save_report(report: DataFrame, path: str, fmt: str = "text") -> str:
    """Write the report next to ``path`` (+ .json / .html / .txt). Any unknown
    format is written as text, like the reference. Returns the file path."""
    import os

    fmt = (fmt or "text").lower()
    if fmt == "json":
        out, body = path + ".json", report_json(report).first()["json"]
        body = json.dumps(json.loads(body), indent=2, ensure_ascii=False)
    elif fmt == "html":
        out, body = path + ".html", report_html(report).first()["html"]
    else:
        out = path + ".txt"
        body = "\n".join(r["line"] for r in report_text_lines(report).orderBy("line_no").collect())
    os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    with open(out, "w", encoding="utf-8") as f:
        f.write(body)
    return out
