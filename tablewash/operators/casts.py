"""Type conversion (int / float / str / datetime) and type inference for text.

``mode='guard'`` reproduces the all-or-nothing rule: a column is converted only
if every non-missing value converts; the test for all requested columns is one
aggregate job. ``mode='coerce'`` converts lazily and leaves failures NULL."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType, StringType, TimestampType, DateType, BooleanType

from tablewash.functions.names import c

log = logging.getLogger(__name__)

TARGETS = ("int", "float", "str", "datetime")

# Formats tried, in order, when a text column is turned into timestamps without
# an explicit format (month before day); see ``choose_datetime_formats``.
DATETIME_FORMATS = (
    None,  # ISO-8601 as the SQL cast reads it
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd.MM.yyyy",
    "dd-MM-yyyy",
    "MM/dd/yyyy HH:mm",
    "dd/MM/yyyy HH:mm",
    "yyyyMMdd",
)

JVM_SUFFIX = r"[0-9.][dDfF]\s*$"
# plain decimal numbers as CSV readers take them; longer whole numbers than 64 bits stay text
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
WHOLE = r"^[+-]?\d+$"
# whole numbers as the cast to bigint takes them: white space and control bytes around them don't count
WHOLE_CAST = r"^[\x00-\x20\x7f]*[+-]?\d+[\x00-\x20\x7f]*$"

EPOCH_DIVISORS = {"ns": 1000, "us": 1, "ms": None, "s": None}


def _to_timestamp(col: Column, dtype: DataType, fmt: str | None, unit: str) -> Column:
    if isinstance(dtype, (TimestampType, DateType)):
        return col.cast("timestamp")
    if isinstance(dtype, NumericType) and not isinstance(dtype, BooleanType):
        whole = col.try_cast("bigint")
        if unit == "ns":
            # exact integer division: a double would lose the last microsecond
            return F.timestamp_micros(F.floor(whole.cast("decimal(20,0)") / F.lit(1000)).cast("bigint"))
        if unit == "us":
            return F.timestamp_micros(whole)
        if unit == "ms":
            return F.timestamp_millis(whole)
        if unit == "s":
            return F.timestamp_seconds(whole)
        raise ValueError(f"unknown epoch unit {unit}")
    text = col.cast("string")
    if fmt is None:
        return text.try_cast("timestamp")
    return F.try_to_timestamp(text, F.lit(fmt))


def text_to_bigint(text: Column) -> Column:
    """``try_cast`` of a text to bigint, tried only where the text looks like a whole number: a failed cast
    is an exception inside, which costs many times what the pattern does."""
    return F.when(text.rlike(WHOLE_CAST), F.btrim(text).try_cast("bigint"))


def convert(col: Column, dtype: DataType, target: str, fmt: str | None = None, unit: str = "ns") -> Column:
    """Column expression for one conversion; failures give NULL."""
    if target == "int":
        if isinstance(dtype, StringType):
            return text_to_bigint(col)
        return col.try_cast("bigint")
    if target == "float":
        d = col.try_cast("double")
        if isinstance(dtype, StringType):  # 1D, 2F: suffixes of the JVM's number parser, not numbers
            d = F.when(col.rlike(JVM_SUFFIX), F.lit(None).cast("double")).otherwise(d)
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    if target == "str":
        return col.cast("string")
    if target == "datetime":
        return _to_timestamp(col, dtype, fmt, unit)
    raise ValueError(f"unknown target type {target}; one of {TARGETS}")


def _present(name: str, dtype: DataType) -> Column:
    if isinstance(dtype, (DoubleType, FloatType)):
        return c(name).isNotNull() & ~F.isnan(c(name))
    return c(name).isNotNull()


@dataclass(frozen=True)
class FormatChoice:
    """Of one text column: the format that reads it (``refused`` False), else a value that broke it."""

    format: str | None
    refused: bool
    broken_by: str | None = None


def judge_datetime_formats(
    df: DataFrame,
    cols: Sequence[str],
    formats: Sequence[str | None] = DATETIME_FORMATS,
    order_cols: Sequence[str] = (),
) -> dict[str, FormatChoice]:
    """One aggregate pass over all text columns: each value has a bit mask of the formats that parse
    it, merged by a bitwise AND.

    With ``order_cols`` (the rows' order, e.g. file and row ordinal) the first format that parses
    the first non-missing value is taken, and the column is refused if a later value breaks it.
    Without them the rows have no order, and the first format that parses every value is taken.
    Both agree wherever the ordered rule converts (a format before the one chosen misses the first
    value, so it can't parse all), and neither depends on how the rows are partitioned. A refused
    column names the least value that the rule's format doesn't parse."""
    if not cols:
        return {}
    everything = (1 << len(formats)) - 1
    order = F.struct(*[c(o) for o in order_cols]) if order_cols else None
    masks, aggs = {}, []
    for i, n in enumerate(cols):
        bits = [F.when(_to_timestamp(c(n), StringType(), f, "ns").isNotNull(), F.lit(1 << j)).otherwise(F.lit(0)) for j, f in enumerate(formats)]
        masks[f"_mask_{i}"] = F.when(c(n).isNotNull(), sum(bits[1:], bits[0]).cast("bigint"))
    fresh = [*cols, *order_cols, *masks]
    if len(set(fresh)) != len(set([*cols, *order_cols])) + len(masks):
        raise ValueError(f"columns named like {list(masks)} can't be judged")
    judged = df.select(*[c(x) for x in dict.fromkeys([*cols, *order_cols])], *[m.alias(k) for k, m in masks.items()])
    for i, n in enumerate(cols):
        mask = F.col(f"_mask_{i}")
        aggs.append(F.bit_and(mask).alias(f"all_{i}"))
        if order_cols:
            aggs.append(F.min_by(mask, F.when(mask.isNotNull(), order)).alias(f"first_{i}"))
        for j in range(len(formats)):
            aggs.append(F.min(F.when(mask.bitwiseAND(F.lit(1 << j)) == 0, c(n))).alias(f"bad_{i}_{j}"))
    row = judged.agg(*aggs).first()
    found = {}
    for i, n in enumerate(cols):
        common = everything if row[f"all_{i}"] is None else row[f"all_{i}"]
        tried = common if not order_cols else (everything if row[f"first_{i}"] is None else row[f"first_{i}"])
        j = (tried & -tried).bit_length() - 1  # the first format of those
        if j >= 0 and common >> j & 1:
            found[n] = FormatChoice(formats[j], False)
        elif j >= 0:
            found[n] = FormatChoice(formats[j], True, row[f"bad_{i}_{j}"])
        else:  # no format reads the first value, or none reads all
            found[n] = FormatChoice(None, True, next((row[f"bad_{i}_{k}"] for k in range(len(formats)) if row[f"bad_{i}_{k}"] is not None), None))
    return found


def choose_datetime_formats(
    df: DataFrame,
    cols: Sequence[str],
    formats: Sequence[str | None] = DATETIME_FORMATS,
    order_cols: Sequence[str] = (),
) -> dict[str, str | None]:
    """The chosen format of each text column; refused columns are left out."""
    return {n: f.format for n, f in judge_datetime_formats(df, cols, formats, order_cols).items() if not f.refused}


def conversion_failures(df: DataFrame, conversions: Mapping[str, str], datetime_format: str | None = None, epoch_unit: str = "ns") -> dict[str, int]:
    """Number of non-missing values that would fail, per column (one job)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if not conversions:
        return {}
    aggs = [
        F.count_if(_present(n, types[n]) & convert(c(n), types[n], t, datetime_format, epoch_unit).isNull()).alias(f"x{i}")
        for i, (n, t) in enumerate(conversions.items())
    ]
    row = df.agg(*aggs).first()
    return {n: int(row[f"x{i}"]) for i, n in enumerate(conversions)}


def fix_types(
    df: DataFrame,
    conversions: Mapping[str, str],
    mode: str = "guard",
    datetime_format: str | None = None,
    epoch_unit: str = "ns",
    missing_ok: bool = False,
    order_cols: Sequence[str] = (),
    refusals: dict[str, str | None] | None = None,
) -> DataFrame:
    """Convert columns: {column: 'int' | 'float' | 'str' | 'datetime'}.

    ``order_cols``: the rows' order, for the choice of a datetime format (see
    ``judge_datetime_formats``). A dict passed as ``refusals`` receives each column that the guard
    refused with the least value that doesn't convert."""
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = [n for n in conversions if n not in types]
    if unknown and not missing_ok:
        raise ValueError(f"unknown columns: {unknown}")
    conv = {n: t.lower() for n, t in conversions.items() if n in types}
    for t in conv.values():
        if t not in TARGETS:
            raise ValueError(f"unknown target type {t}; one of {TARGETS}")
    formats: dict[str, str | None] = {}
    text_dt = [n for n, t in conv.items() if t == "datetime" and isinstance(types[n], StringType)]
    judged: dict[str, FormatChoice] = {}
    if text_dt and datetime_format is None:
        judged = judge_datetime_formats(df, text_dt, order_cols=order_cols)
        formats = {n: f.format for n, f in judged.items() if not f.refused}
    if mode == "guard":
        broken = {n: f.broken_by for n, f in judged.items() if f.refused}
        tested = {n: t for n, t in conv.items() if n not in judged}
        if tested:
            failing = {
                n: _present(n, types[n]) & convert(c(n), types[n], t, datetime_format, epoch_unit).isNull() for n, t in tested.items()
            }
            aggs = [x for i, (n, bad) in enumerate(failing.items()) for x in (
                F.count_if(bad).alias(f"x{i}"), F.min(F.when(bad, c(n).cast("string"))).alias(f"v{i}"))]
            row = df.agg(*aggs).first()
            broken |= {n: row[f"v{i}"] for i, n in enumerate(tested) if row[f"x{i}"]}
        if broken:
            log.warning("conversion refused (values do not convert): %s", dict(sorted(broken.items())))
        if refusals is not None:
            refusals.update(broken)
        conv = {n: t for n, t in conv.items() if n not in broken}
    elif mode != "coerce":
        raise ValueError("mode must be 'guard' or 'coerce'")
    if not conv:
        return df
    return df.withColumns({n: convert(c(n), types[n], t, formats.get(n, datetime_format), epoch_unit) for n, t in conv.items()})


# ------------------------------------------------------------- inference

# pandas' default missing-value tokens for CSV input (fixed values)
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# spellings pandas reads as booleans (fixed values)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")


def na_to_null(df: DataFrame, cols: Sequence[str] | None = None, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [n for n in (cols or df.columns) if isinstance(types[n], StringType)]
    toks = list(tokens)
    return df.withColumns({n: F.when(c(n).isin(toks), F.lit(None).cast("string")).otherwise(c(n)) for n in cols}) if cols else df

# spellings that need no trial cast: at most 18 digits always fit a bigint
PLAIN_WHOLE = r"^[+-]?\d{1,18}\z"
PLAIN_DECIMAL = r"^[+-]?\d+\.\d*\z"
# what a value rules out
NOT_WHOLE, NOT_NUMBER, NOT_BOOLEAN = 1, 2, 4


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns -> bigint, double or boolean when every non-missing value
    fits (in that order); all-missing columns stay text. One aggregate job."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [n for n in (cols or df.columns) if isinstance(types[n], StringType)]
    if not cols:
        return df
    bools = list(TRUE_TOKENS + FALSE_TOKENS)
    aggs = []
    for i, n in enumerate(cols):
        v = c(n)
        # the common spellings first, so most values see one or two patterns
        odd_number = ~F.btrim(v).rlike(NUMBER) | (F.btrim(v).rlike(WHOLE) & F.btrim(v).try_cast("bigint").isNull())
        bits = (
            F.when(v.rlike(PLAIN_WHOLE), F.lit(NOT_BOOLEAN))
            .when(v.rlike(PLAIN_DECIMAL), F.lit(NOT_WHOLE | NOT_BOOLEAN))
            .when(v.isin(bools), F.lit(NOT_WHOLE | NOT_NUMBER))
            .when(v.isNotNull(), F.when(text_to_bigint(v).isNull(), F.lit(NOT_WHOLE)).otherwise(F.lit(0))
                  .bitwiseOR(F.when(odd_number, F.lit(NOT_NUMBER)).otherwise(F.lit(0))).bitwiseOR(F.lit(NOT_BOOLEAN)))
        )
        aggs.append(F.bit_or(bits).alias(f"bits{i}"))
    row = df.agg(*aggs).first()
    fixes = {}
    for i, n in enumerate(cols):
        bits = row[f"bits{i}"]
        if bits is None:  # nothing but missing values
            continue
        if not bits & NOT_WHOLE:
            fixes[n] = F.btrim(c(n)).try_cast("bigint")
        elif not bits & NOT_NUMBER:
            fixes[n] = F.btrim(c(n)).try_cast("double")
        elif not bits & NOT_BOOLEAN:
            fixes[n] = F.when(c(n).isNull(), F.lit(None).cast("boolean")).otherwise(c(n).isin(list(TRUE_TOKENS)))
    return df.withColumns(fixes) if fixes else df
