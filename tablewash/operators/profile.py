"""Table profile: rows, columns, missing per column, duplicate rows, types.

One aggregate serves all of it: ``groupBy(all columns).count()`` (partial
aggregation, one shuffle of distinct rows) gives the duplicate count, and the
row and missing counts are sums over the grouped rows weighted by their count,
so the table is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, MapType

from tablewash.functions.missing import is_missing
from tablewash.functions.names import c


def group_expr(name: str, dtype):
    """Grouping key of a column for duplicate detection: map columns compare
    as sorted entry arrays; in float columns NaN is missing, so it groups with
    NULL (pandas treats both as the same missing value)."""
    if isinstance(dtype, MapType):
        return F.array_sort(F.map_entries(c(name)))
    if isinstance(dtype, (DoubleType, FloatType)):
        return F.when(F.isnan(c(name)), F.lit(None).cast(dtype)).otherwise(c(name))
    return c(name)


def groupable(df: DataFrame) -> DataFrame:
    fixes = {
        f.name: group_expr(f.name, f.dataType)
        for f in df.schema.fields
        if isinstance(f.dataType, (MapType, DoubleType, FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def profile_table(df: DataFrame, approx_duplicates: bool = False, rsd: float = 0.01) -> DataFrame:
    """One row: n_rows, n_distinct, duplicates, m_0 .. m_{k-1} (missing per column).

    ``approx_duplicates=True`` skips the shuffle of distinct rows: one pass
    with a HyperLogLog sketch of a 64-bit row hash (relative standard error
    ``rsd`` on the distinct count, plus hash collisions, negligible below
    billions of distinct rows). For tables where even one shuffle of the
    distinct rows is too much; the exact count is the default."""
    fields = df.schema.fields
    g = groupable(df)
    if not fields:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_rows"))
    if approx_duplicates:
        # one pass: row count, missing counts and the sketch in a single aggregate
        out = g.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.approx_count_distinct(F.xxhash64(*[c(f.name) for f in fields]), rsd).alias("_sketch"),
            *[F.count_if(is_missing(f.name, f.dataType)).cast("bigint").alias(f"m_{i}") for i, f in enumerate(fields)],
        )
        out = out.select(
            "n_rows", F.least(F.col("_sketch").cast("bigint"), F.col("n_rows")).alias("n_distinct"),
            *[f"m_{i}" for i in range(len(fields))],
        )
        return out.withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))
    grouped = g.groupBy(*[c(f.name) for f in fields]).agg(F.count(F.lit(1)).alias("_cnt"))
    aggs = [
        F.coalesce(F.sum("_cnt"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
    ]
    aggs += [
        F.coalesce(F.sum(F.when(is_missing(f.name, f.dataType), F.col("_cnt")).otherwise(0)), F.lit(0))
        .cast("bigint")
        .alias(f"m_{i}")
        for i, f in enumerate(fields)
    ]
    out = grouped.agg(*aggs)
    return out.withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))


def missing_profile(df: DataFrame) -> DataFrame:
    """One row: n_rows and m_i, without the duplicate count (no shuffle)."""
    fields = df.schema.fields
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m_{i}") for i, f in enumerate(fields)],
    )


def snapshot(df: DataFrame, approx_duplicates: bool = False) -> DataFrame:
    """Quality snapshot as one row: rows, columns, duplicates,
    missing_values MAP<column, count>, column_types MAP<column, type>."""
    names = [f.name for f in df.schema.fields]
    p = profile_table(df, approx_duplicates)
    keys = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    miss = F.array(*[F.col(f"m_{i}") for i in range(len(names))]) if names else F.array().cast("array<bigint>")
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields]) if names else F.array().cast("array<string>")
    return p.select(
        F.col("n_rows").alias("rows"),
        F.lit(len(names)).alias("columns"),
        F.col("duplicates"),
        F.map_from_arrays(keys, miss).alias("missing_values"),
        F.map_from_arrays(keys, types).alias("column_types"),
    )


def snapshot_long(df: DataFrame, approx_duplicates: bool = False) -> DataFrame:
    """Snapshot in long form (metric, column_name, value): rows / columns /
    duplicates with column_name '*', and one 'missing' row per column."""
    names = [f.name for f in df.schema.fields]
    p = profile_table(df, approx_duplicates)
    def entry(metric, column, value):
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(column).alias("column_name"), value.cast("bigint").alias("value")
        )

    entries = [
        entry("rows", "*", F.col("n_rows")),
        entry("columns", "*", F.lit(len(names))),
        entry("duplicates", "*", F.col("duplicates")),
    ] + [entry("missing", n, F.col(f"m_{i}")) for i, n in enumerate(names)]
    return p.select(F.inline(F.array(*entries)))


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column_name, position, missing) for every column; one pass, no shuffle."""
    names = [f.name for f in df.schema.fields]
    p = missing_profile(df)
    entries = [F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("position"), F.col(f"m_{i}").alias("missing")) for i, n in enumerate(names)]
    return p.select(F.inline(F.array(*entries)))


def duplicate_summary(df: DataFrame, approx_duplicates: bool = False) -> DataFrame:
    """(n_rows, n_distinct, duplicates): full-row duplicates, missing = missing."""
    return profile_table(df, approx_duplicates).select("n_rows", "n_distinct", "duplicates")


def column_types(df: DataFrame) -> DataFrame:
    """(column_name, position, data_type) from the schema; no scan."""
    rows = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, data_type string")


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` rows (shown next to a key-column candidate). A limit is
    the feature here: Spark stops reading once ``n`` rows are found."""
    return df.limit(n)
