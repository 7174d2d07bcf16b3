"""Notes of many sheets, each with roles of its own, as one plan.

Every (file, sheet) is a table of its own: its header names its session, patient and text columns, its
patient is the first value of its own patient column (or the sheet's name), its rows and sessions are
numbered by themselves. Nothing of this is a plan per sheet: the roles are data, one narrow row per
sheet made by one partial aggregate over the rows (first header, then positions of the role names in
it), joined in by (file, sheet); the values are picked from each row's cells by position. A thousand
workbooks of a thousand layouts are the same four steps as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewash.functions.text import unicode_trim
from tablewash.operators.casts import FALSE_TOKENS, NA_TOKENS, NUMBER, TRUE_TOKENS, WHOLE
from tablewash.plans.extract import EMPTY_TEXT, PATIENT_NAMES, SESSION_NAMES, TEXT_NAMES
from tablewash.sources.workbook import MAX_BROADCAST_SHEETS

SHEET = ("path", "sheet_pos")
# sheets named in the error about missing text columns
NAMED = 5


def _position(cells: Column, candidates: Sequence[str]) -> Column:
    """1-based place of the first cell that is a candidate, trimmed and lower-cased; NULL without one."""
    names = F.transform(cells, lambda x: F.lower(unicode_trim(x)))
    places = F.array(*[F.array_position(names, F.lit(x)) for x in candidates])
    return F.array_min(F.filter(places, lambda p: p > 0))


def sheet_roles(rows: DataFrame) -> DataFrame:
    """One row per sheet: path, sheet_pos, sheet, header_row and the places of the session, patient and text
    columns (NULL: there is none). ``rows``: path, sheet, sheet_pos, row_num, cells."""
    header = rows.groupBy(*SHEET, "sheet").agg(F.min("row_num").alias("header_row"), F.min_by("cells", "row_num").alias("header"))
    return header.select(
        *SHEET, "sheet", "header_row",
        _position(F.col("header"), SESSION_NAMES).alias("session_at"),
        _position(F.col("header"), PATIENT_NAMES).alias("patient_at"),
        _position(F.col("header"), TEXT_NAMES).alias("text_at"),
    )


def _kind_flags(name: str) -> list[Column]:
    """Whether any value of the sheet's column is no whole number, no number, no boolean."""
    v = F.btrim(name)
    whole = v.try_cast("bigint")
    there = F.col(name).isNotNull()
    return [
        F.count_if(there & whole.isNull()).alias(f"{name}_longs"),
        F.count_if(there & (~v.rlike(NUMBER) | (v.rlike(WHOLE) & whole.isNull()))).alias(f"{name}_doubles"),
        F.count_if(there & ~F.col(name).isin(list(TRUE_TOKENS + FALSE_TOKENS))).alias(f"{name}_bools"),
    ]


def _as_text(name: str, value: Column | None = None) -> Column:
    """The value as text of the narrowest type that holds the whole column of its sheet."""
    v = F.col(name) if value is None else value
    return (
        F.when(F.col(f"{name}_longs") == 0, F.btrim(v).try_cast("bigint").cast("string"))
        .when(F.col(f"{name}_doubles") == 0, F.btrim(v).try_cast("double").cast("string"))
        .when(F.col(f"{name}_bools") == 0, F.initcap(v))
        .otherwise(v)
    )


def sheet_notes(rows: DataFrame) -> DataFrame:
    """(sheet, patient_id, session, row_ordinal, text) of all sheets, empty notes dropped, in the shape
    of ``extract.prepare_notes``; ``sheet`` is a key of (file, sheet).

    row_ordinal counts rows below the sheet's header. Without a session column the session is
    ``session_<row_ordinal>``; a missing session is 'nan'. Without a patient column the patient is the sheet's
    name; a patient column without values gives 'unknown'. A sheet without rows below its header gives none;
    one without a text column raises, as no note of it could be read."""
    roles = sheet_roles(rows).checkpoint()  # a row per sheet
    without = roles.where(F.col("text_at").isNull()).select("path", "sheet").limit(NAMED).collect()
    if without:
        raise ValueError("no text column in " + ", ".join(f"sheet {r['sheet']!r} of {r['path']}" for r in without))
    small = roles.count() <= MAX_BROADCAST_SHEETS

    def per_sheet(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small else table

    def picked(place: str) -> Column:
        value = F.try_element_at(F.col("cells"), F.col(place).cast("int"))
        return F.when(~value.isin(list(NA_TOKENS)), value)

    body = rows.drop("sheet").join(per_sheet(roles), list(SHEET)).where(F.col("row_num") > F.col("header_row"))
    values = body.select(
        *SHEET, "sheet", (F.col("row_num") - F.col("header_row")).cast("bigint").alias("row_ordinal"),
        F.col("session_at").isNotNull().alias("has_session"), F.col("patient_at").isNotNull().alias("has_patient"),
        picked("session_at").alias("session"), picked("patient_at").alias("patient"), picked("text_at").alias("text"),
    )
    found = values.groupBy(*SHEET).agg(
        F.min_by("patient", F.when(F.col("patient").isNotNull(), F.col("row_ordinal"))).alias("first_patient"),
        *[flag for name in ("session", "patient", "text") for flag in _kind_flags(name)],
    )
    joined = values.join(per_sheet(found), list(SHEET))
    patient = F.when(F.col("has_patient"), F.coalesce(_as_text("patient", F.col("first_patient")), F.lit("unknown"))).otherwise(
        F.coalesce(F.nullif(F.col("sheet"), F.lit("")), F.lit("unknown"))
    )
    session = F.when(F.col("has_session"), F.coalesce(_as_text("session"), F.lit("nan"))).otherwise(
        F.concat(F.lit("session_"), F.col("row_ordinal").cast("string"))
    )
    notes = joined.select(
        F.concat_ws("#", "path", F.col("sheet_pos").cast("string")).alias("sheet"),
        patient.alias("patient_id"), session.alias("session"), "row_ordinal", _as_text("text").alias("text"),
    )
    return notes.where(~F.lower(F.coalesce(F.col("text"), F.lit("nan"))).isin(list(EMPTY_TEXT)))
