"""Union by column name with type widening (the reference's sheet merge)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType,
    NullType, ShortType, StringType, TimestampNTZType, TimestampType,
)

from tablewash.functions.names import c

_INTEGRAL_RANK = {ByteType: 1, ShortType: 2, IntegerType: 3, LongType: 4}


def common_type(a: DataType, b: DataType) -> DataType:
    """int < bigint < double; anything with text -> text; timestamp with date ->
    timestamp; other mixes -> text."""
    if a == b:
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(b, NullType):
        return a
    ta, tb = type(a), type(b)
    if ta in _INTEGRAL_RANK and tb in _INTEGRAL_RANK:
        return a if _INTEGRAL_RANK[ta] >= _INTEGRAL_RANK[tb] else b
    numeric = tuple(_INTEGRAL_RANK) + (FloatType, DoubleType, DecimalType)
    if isinstance(a, numeric) and isinstance(b, numeric):
        return DoubleType()
    times = (DateType, TimestampType, TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return TimestampType()
    return StringType()


def union_by_name(frames: Sequence[DataFrame], source_col: str | None = None, sources: Sequence[str] | None = None) -> DataFrame:
    """Union by column name; absent columns become NULL; first-seen column
    order; shared columns widened to a common type first. Optional
    ``source_col`` records which input (e.g. sheet) a row came from."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to union")
    order: list[str] = []
    types: dict[str, DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            if f.name not in types:
                order.append(f.name)
                types[f.name] = f.dataType
            else:
                types[f.name] = common_type(types[f.name], f.dataType)
    out = None
    for i, df in enumerate(frames):
        have = set(df.columns)
        cols = [(c(n).cast(types[n]) if n in have else F.lit(None).cast(types[n])).alias(n) for n in order]
        if source_col:
            cols.append(F.lit(sources[i] if sources else str(i)).alias(source_col))
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part)
    return out
