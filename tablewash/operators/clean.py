"""Cleaning steps. Each is ``(df, **params) -> DataFrame``.

Most steps only add expressions to the plan. Three run a job when called:
``drop_cols_any`` (the schema depends on the data), ``fill_literal`` when a
column might have to widen to text (one aggregate), and the exact
``fill_median`` (a few histogram scans).

``key_columns`` are left out of every step (the reference's promoted index)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, MapType, NumericType, StringType

from tablewash.functions.missing import is_missing, normalize_nan
from tablewash.functions.names import c
from tablewash.functions.text import title_case, unicode_trim
from tablewash.operators import stats
from tablewash.operators.duplicates import count_duplicates, distinct_rows
from tablewash.operators.profile import group_expr, missing_profile



def numeric_columns(df: DataFrame, key_columns: Iterable[str] = ()) -> list[str]:
    keys = set(key_columns)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType) and f.name not in keys
    ]


def text_columns(df: DataFrame, key_columns: Iterable[str] = ()) -> list[str]:
    keys = set(key_columns)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in keys]


def _check_columns(df: DataFrame, cols: Sequence[str], missing_ok: bool = False) -> list[str]:
    unknown = [x for x in cols if x not in df.columns]
    if unknown and not missing_ok:
        raise ValueError(f"unknown columns: {unknown}")
    return [x for x in cols if x in df.columns]


# ---------------------------------------------------------------- zeros

def replace_zeros(df: DataFrame, columns: str | Sequence[str] | None = "all", key_columns: Iterable[str] = ()) -> DataFrame:
    """Value equal to 0 (also 0.0 and -0.0) -> NULL; the column keeps its type.
    ``columns``: 'all' (every numeric column), a list, or None / 'none' (no-op)."""
    if columns is None or (isinstance(columns, str) and columns.lower() == "none"):
        return df
    if isinstance(columns, str) and columns.lower() == "all":
        cols = numeric_columns(df, key_columns)
    else:
        cols = _check_columns(df, [columns] if isinstance(columns, str) else list(columns))
    numeric = set(numeric_columns(df))
    cols = [n for n in cols if n in numeric]  # text never equals the number 0
    return df.withColumns({n: F.nullif(c(n), F.lit(0)) for n in cols}) if cols else df


# ---------------------------------------------------------------- missing

def drop_rows_any(df: DataFrame, key_columns: Iterable[str] = ()) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in any non-key column."""
    keys = set(key_columns)
    fields = [f for f in df.schema.fields if f.name not in keys]
    if not fields:
        return df
    cond = None
    for f in fields:
        m = is_missing(f.name, f.dataType)
        cond = m if cond is None else (cond | m)
    return df.where(~cond)


def columns_with_missing(df: DataFrame, key_columns: Iterable[str] = ()) -> list[str]:
    """One aggregate job: names of non-key columns holding a missing value."""
    keys = set(key_columns)
    row = missing_profile(df).first()
    return [f.name for i, f in enumerate(df.schema.fields) if f.name not in keys and row[f"m_{i}"] > 0]


def drop_cols_any(df: DataFrame, key_columns: Iterable[str] = ()) -> DataFrame:
    """Drop every non-key column holding a missing value. The resulting schema
    depends on the data, so this step runs one aggregate job."""
    drop = columns_with_missing(df, key_columns)
    return df.drop(*drop) if drop else df


def _fill_from_row(df: DataFrame, row: DataFrame, cols: Sequence[str], cast: str | None = None) -> DataFrame:
    """coalesce(col, stat) with the statistics in a one-row DataFrame.

    Each statistic is a scalar subquery over that row; Spark merges them into
    one subquery that runs once before the main stage and inlines the values,
    so the main pipeline has no join and stays in one whole-stage-codegen span."""
    if not cols:
        return df
    fills = {}
    for n in cols:
        stat = row.select(c(n)).scalar()
        fills[n] = F.coalesce(c(n).cast(cast), stat.cast(cast)) if cast else F.coalesce(c(n), stat)
    return df.withColumns(fills)


def _nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    schema = {f.name: f.dataType for f in df.schema.fields}
    fixes = {n: F.when(is_missing(n, schema[n]), F.lit(None).cast(schema[n])).otherwise(c(n)) for n in cols}
    return df.withColumns(fixes) if fixes else df


def _numeric_with_missing(df: DataFrame, key_columns: Iterable[str]) -> list[str]:
    cols = numeric_columns(df, key_columns)
    return columns_with_missing(df.select(*[c(n) for n in cols])) if cols else []


def fill_mean(df: DataFrame, key_columns: Iterable[str] = ()) -> DataFrame:
    """Numeric columns with a missing value: missing -> column mean, the column becomes double.
    Columns with nothing missing keep type and values (one aggregate job finds them)."""
    cols = _numeric_with_missing(df, key_columns)
    return _fill_from_row(_nan_to_null(df, cols), stats.means(df, cols), cols, cast="double")


def fill_median(df: DataFrame, key_columns: Iterable[str] = (), approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Numeric columns: missing -> exact median (mean of the middle two), as
    double. ``approx=True`` uses ``percentile_approx`` instead: one pass and a
    bounded sketch per column, a value of the column within 1/accuracy rank.
    Columns with nothing missing keep type and values."""
    cols = _numeric_with_missing(df, key_columns)
    if approx:
        if not cols:
            return df
        clean_df = _nan_to_null(df, cols)
        row = clean_df.agg(*[F.percentile_approx(c(n).cast("double"), 0.5, accuracy).alias(n) for n in cols])
        return _fill_from_row(clean_df, row, cols, cast="double")
    return _fill_from_row(_nan_to_null(df, cols), stats.medians(df, cols), cols, cast="double")


def fill_mode(df: DataFrame, key_columns: Iterable[str] = ()) -> DataFrame:
    """Every non-key column: missing -> most frequent value (lowest on ties)."""
    keys = set(key_columns)
    cols = [f.name for f in df.schema.fields if f.name not in keys]
    return _fill_from_row(_nan_to_null(df, cols), stats.modes(df, cols), cols)


def fill_literal(df: DataFrame, value, key_columns: Iterable[str] = (), on_mismatch: str = "widen") -> DataFrame:
    """Missing -> one literal in every non-key column. Where the literal converts
    to the column's type it is used typed. Where it does not, ``'widen'`` turns
    the column into text (the reference's mixed column) if, and only if, the
    column has a missing value (one aggregate job decides); ``'skip'`` leaves
    such columns alone without any job."""
    if on_mismatch not in ("widen", "skip"):
        raise ValueError("on_mismatch must be 'widen' or 'skip'")
    spark = df.sparkSession
    keys = set(key_columns)
    fields = [f for f in df.schema.fields if f.name not in keys]
    if not fields:
        return df
    lit = F.lit(value)
    probes = spark.range(1).select(*[lit.try_cast(f.dataType).alias(f"p{i}") for i, f in enumerate(fields)]).first()
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    # a number that the column's type would change (12.7 in a bigint): the column becomes double
    lossy = {f.name for i, f in enumerate(fields) if number and isinstance(f.dataType, NumericType) and probes[f"p{i}"] is not None and float(probes[f"p{i}"]) != float(value) and not isinstance(f.dataType, (DoubleType, FloatType))}
    typed = [f for i, f in enumerate(fields) if probes[f"p{i}"] is not None and f.name not in lossy]
    misfit = [f for i, f in enumerate(fields) if probes[f"p{i}"] is None or f.name in lossy]
    fills = {f.name: F.when(is_missing(f.name, f.dataType), lit.try_cast(f.dataType)).otherwise(c(f.name)) for f in typed}
    if misfit and on_mismatch == "widen":
        counts = df.agg(*[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(misfit)]).first()
        for i, f in enumerate(misfit):
            if counts[f"m{i}"] > 0:
                wide = "double" if f.name in lossy else "string"
                fills[f.name] = F.when(is_missing(f.name, f.dataType), lit.cast(wide)).otherwise(c(f.name).cast(wide))
    return df.withColumns(fills) if fills else df


FILL_METHODS = {"mean": fill_mean, "median": fill_median, "mode": fill_mode}


def handle_missing(df: DataFrame, method: str, fill_value=None, key_columns: Iterable[str] = ()) -> DataFrame:
    """drop_rows | drop_cols | fill (mean / median / mode / literal)."""
    method = method.lower()
    if method == "drop_rows":
        return drop_rows_any(df, key_columns)
    if method == "drop_cols":
        return drop_cols_any(df, key_columns)
    if method == "fill":
        if fill_value is None:
            raise ValueError("fill needs fill_value")
        if isinstance(fill_value, str) and fill_value.lower() in FILL_METHODS:
            return FILL_METHODS[fill_value.lower()](df, key_columns=key_columns)
        return fill_literal(df, fill_value, key_columns=key_columns)
    raise ValueError(f"unknown missing-value method: {method}")


# ---------------------------------------------------------------- duplicates

def remove_duplicates(df: DataFrame, key_columns: Iterable[str] = (), order_col: str | None = None, hash_first: bool = False) -> DataFrame:
    """Full-row distinct over the non-key columns (missing equals missing).

    Without key columns this is ``dropDuplicates()``: one hash aggregate with a map-side combine, so a row
    repeated a billion times is collapsed before the shuffle. ``hash_first=True`` is for wide, mostly unique rows:
    a job counts row digests, and rows whose digest is seen once don't move (``duplicates.distinct_rows``;
    the same result, the table is read twice). With key columns the kept row is the one with the lowest
    ``order_col`` (default: the key columns in turn; a missing key comes last, and the row
    stays whole); ``min_by`` is also partial."""
    keys = [k for k in key_columns if k in df.columns]
    # missing is NULL: NaN and NULL are one missing value, as in the profile
    df = normalize_nan(df)
    has_map = any(isinstance(f.dataType, MapType) for f in df.schema.fields)
    if not keys and not has_map:
        return distinct_rows(df) if hash_first else df.dropDuplicates()
    subset = [x for x in df.columns if x not in keys]
    return _dedup_keep_first(df, subset, [order_col, *keys] if order_col else keys)


def _dedup_keep_first(df: DataFrame, subset: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    gkeys = [group_expr(n, types[n]).alias(f"_tw_k{i}") for i, n in enumerate(subset)]
    # min_by skips NULL orders: a struct is never NULL
    order = F.struct(F.lit(0), *[x for n in order_cols for x in (c(n).isNull(), c(n))])
    kept = df.groupBy(*gkeys).agg(F.min_by(F.struct(*[c(x) for x in df.columns]), order).alias("_tw_row"))
    return kept.select(*[F.col("_tw_row")[x].alias(x) for x in df.columns])


def duplicate_rows(df: DataFrame, key_columns: Iterable[str] = ()) -> int:
    """Rows that repeat an earlier one in the non-key columns (exact, digests first)."""
    keys = set(key_columns)
    return count_duplicates(df, [x for x in df.columns if x not in keys])


# ---------------------------------------------------------------- text

def trim_text(df: DataFrame, columns: Sequence[str] | None = None, key_columns: Iterable[str] = ()) -> DataFrame:
    """Strip Unicode whitespace (Python's rule) at both ends of text columns."""
    cols = text_columns(df, key_columns) if columns is None else _check_columns(df, columns)
    return df.withColumns({n: unicode_trim(c(n)) for n in cols}) if cols else df


CASES = ("lowercase", "uppercase", "titlecase", "none")


def standardize_case(df: DataFrame, case: str, columns: Sequence[str] | None = None, key_columns: Iterable[str] = ()) -> DataFrame:
    case = case.lower()
    if case not in CASES:
        raise ValueError(f"unknown case: {case}; one of {CASES}")
    if case == "none":
        return df
    cols = text_columns(df, key_columns) if columns is None else _check_columns(df, columns)
    fn = {"lowercase": F.lower, "uppercase": F.upper, "titlecase": title_case}[case]
    return df.withColumns({n: fn(c(n)) for n in cols}) if cols else df
