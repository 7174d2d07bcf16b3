"""One-column sort with missing values last in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewash.functions.names import c


def sort_by(df: DataFrame, column: str | None, ascending: bool = True) -> DataFrame:
    """Global sort (range partitioning + local sort). Unknown or empty column:
    returned unsorted, like the reference.

    A hash of the whole row is the second sort key: ties may come in any
    order, and with it the range partitioner can split a value that holds a
    large share of the rows over several partitions instead of one task."""
    if not column or column not in df.columns:
        return df
    key = c(column).asc_nulls_last() if ascending else c(column).desc_nulls_last()
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.orderBy(key, F.xxhash64(*[c(x) for x in hashable])) if hashable else df.orderBy(key)
