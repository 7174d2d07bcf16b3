"""Column statistics used by the fill steps, built to stay distributed.

Spark's ``median`` / ``mode`` aggregates keep a value->count map of the whole
column in one final task, so a high-cardinality column at scale lands in one
task's memory. Here every statistic starts from ``groupBy(column, value).count()``
(partial aggregation on the map side, so a hot value costs nothing), and:

* mode   = per column ``min_by(value, (-count, value))`` (partial aggregate)
* median = histogram refinement: values are counted by bucket (first by sign and binary exponent, then
           by equal steps between a bucket's least and greatest value), and the bucket that holds the
           middle is refined until few values are left. Every scan shuffles at most one row per task,
           column and bucket, however many distinct values there are; exact, in a handful of scans

All results have one row per column and are turned into one row for a
broadcast cross join (size: one row, fixed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from tablewash.functions.names import c


def _value_slots(df: DataFrame, cols: Sequence[str]) -> tuple[list[DataType], dict[str, int]]:
    types: list[DataType] = []
    slot: dict[str, int] = {}
    schema = {f.name: f.dataType for f in df.schema.fields}
    for name in cols:
        dt = schema[name]
        for i, t in enumerate(types):
            if t == dt:
                slot[name] = i
                break
        else:
            types.append(dt)
            slot[name] = len(types) - 1
    return types, slot


def _present(name: str, dt: DataType):
    col = c(name)
    if isinstance(dt, (DoubleType, FloatType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def value_counts(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[DataType], dict[str, int]]:
    """Long table (k, v, cnt): v is a struct with one slot per distinct column
    type, only the slot of column k set, so values keep their own ordering."""
    types, slot = _value_slots(df, cols)
    schema = {f.name: f.dataType for f in df.schema.fields}
    entries = []
    for name in cols:
        fields = [
            (c(name) if i == slot[name] else F.lit(None).cast(t)).alias(f"s{i}") for i, t in enumerate(types)
        ]
        entries.append(
            F.when(_present(name, schema[name]), F.struct(F.lit(name).alias("k"), F.struct(*fields).alias("v")))
        )
    long = df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.k", "e.v")
    counts = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt"))
    return counts, types, slot


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, one column per input column: most frequent non-missing value,
    lowest value on ties. All-missing column -> NULL."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.range(1).select()
    counts, types, slot = value_counts(df, cols)
    best = counts.groupBy("k").agg(F.min_by("v", F.struct((-F.col("cnt")).alias("n"), F.col("v"))).alias("m"))
    row = best.groupBy().agg(
        *[F.max(F.when(F.col("k") == name, F.col(f"m.s{slot[name]}"))).alias(name) for name in cols]
    )
    return row


# buckets of one refinement; values that are listed instead of refined further (per column)
BUCKETS = 4096
LISTED = 1 << 15
# places of sign and exponent: exponents of doubles lie between -1074 and 1023
EXPONENTS = 2200


def _exponent_bucket(v: Column) -> Column:
    """Sign and binary exponent as one number that never falls as the value grows (logarithms of
    doubles are semi-monotonic)."""
    size = F.floor(F.log2(F.abs(v))) + EXPONENTS
    return F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * 2 * EXPONENTS).otherwise(F.signum(v) * size).cast("bigint")


def _step_bucket(v: Column, lo: float, hi: float) -> Column:
    """Place of the value among equal steps from ``lo`` to ``hi`` (of one sign and exponent: their difference is exact)."""
    return F.floor(F.least(F.lit(float(BUCKETS - 1)), (v - F.lit(lo)) / F.lit(hi - lo) * BUCKETS)).cast("bigint")


def _middle(values: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column ``names`` of ``values`` (doubles; NULL and NaN don't count)."""
    # of each open column: the range that holds its middle values, and how many values lie below it
    ranges: dict[str, tuple[float, float, int] | None] = {n: None for n in names}
    middle: dict[str, tuple[int, int]] = {}  # places of the two middle values
    found: dict[str, float | None] = {}
    while ranges:
        entries = []
        for i, (n, r) in enumerate(ranges.items()):
            v = c(n)
            there = _present(n, DoubleType()) if r is None else (v >= F.lit(r[0])) & (v <= F.lit(r[1])) & ~F.isnan(v)
            bucket = _exponent_bucket(v) if r is None else _step_bucket(v, r[0], r[1])
            entries.append(F.when(there, F.struct(F.lit(i).alias("i"), bucket.alias("b"), v.alias("v"))))
        long = values.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
        counted = long.groupBy("i", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # bounded: buckets x columns
        to_list: dict[str, tuple[float, float, int]] = {}
        for i, n in enumerate(list(ranges)):
            buckets = sorted((r for r in counted if r["i"] == i), key=lambda r: r["b"])
            below = ranges[n][2] if ranges[n] else 0
            if n not in middle:
                total = sum(r["n"] for r in buckets)
                if not total:
                    found[n] = None
                    del ranges[n]
                    continue
                middle[n] = ((total - 1) // 2, total // 2)
            held = []  # the buckets that hold the middle values (two at most)
            for r in buckets:
                if below + r["n"] > middle[n][0] and below <= middle[n][1]:
                    held.append((r, below))
                below += r["n"]
            lo, hi, under = held[0][0]["lo"], held[-1][0]["hi"], held[0][1]
            if all(r["lo"] == r["hi"] for r, _ in held):  # one value each, whatever its count
                found[n] = lo if len(held) == 1 else _mean(lo, hi)
                del ranges[n]
            elif len(held) == 2 and held[0][1] + held[0][0]["n"] == middle[n][1]:
                # the last of one bucket and the first of the next one
                found[n] = _mean(held[0][0]["hi"], held[1][0]["lo"])
                del ranges[n]
            elif sum(r["n"] for r, _ in held) <= LISTED:
                to_list[n] = (lo, hi, under)
                del ranges[n]
            else:
                ranges[n] = (lo, hi, under)
        if to_list:
            lists = values.agg(*[F.sort_array(F.collect_list(F.when((c(n) >= F.lit(lo)) & (c(n) <= F.lit(hi)) & ~F.isnan(c(n)), c(n)))).alias(f"l{i}") for i, (n, (lo, hi, _)) in enumerate(to_list.items())]).first()
            for i, (n, (_, _, under)) in enumerate(to_list.items()):
                found[n] = _mean(lists[f"l{i}"][middle[n][0] - under], lists[f"l{i}"][middle[n][1] - under])
    return found


def _mean(a: float, b: float) -> float:
    return a if a == b else (a + b) / 2


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: exact median (mean of the two middle values) per numeric column,
    as double. Missing and NaN are ignored; all-missing column -> NULL. Runs its scans when called."""
    cols = list(cols)
    spark = df.sparkSession
    if not cols:
        return spark.range(1).select()
    found = _middle(df.select(*[c(n).cast("double").alias(n) for n in cols]), cols)
    return spark.range(1).select(*[F.lit(found[n]).cast("double").alias(n) for n in cols])


def means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean per column (ignoring missing and NaN)."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    return df.agg(*[F.avg(F.when(_present(n, schema[n]), c(n))).alias(n) for n in cols]) if cols else df.sparkSession.range(1).select()
