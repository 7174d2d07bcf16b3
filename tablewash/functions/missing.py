"""Missing values. The reference treats None, NaN and NaT alike; Spark keeps
NULL and NaN apart (``avg`` over one NaN is NaN, ``distinct`` keeps both). Every
source normalizes NaN to NULL once, and the tests below also count NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from tablewash.functions.names import c


def _is_float(dt: DataType) -> bool:
    return isinstance(dt, (DoubleType, FloatType))


def is_missing(name: str, dtype: DataType) -> Column:
    """NULL, or NaN for floating columns."""
    col = c(name)
    if _is_float(dtype):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_count(name: str, dtype: DataType) -> Column:
    return F.count_if(is_missing(name, dtype))


def normalize_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float/double column (one projection)."""
    fixes = {
        f.name: F.when(F.isnan(c(f.name)), F.lit(None).cast(f.dataType)).otherwise(c(f.name))
        for f in df.schema.fields
        if _is_float(f.dataType)
    }
    return df.withColumns(fixes) if fixes else df
