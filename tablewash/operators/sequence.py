"""Skew-safe running totals and row numbers.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to
one task, so a group holding a third of the table becomes one straggler task.
Here the rows are range-partitioned on (g, o) instead: a hot group is spread
over many partitions, each partition numbers its own slice, and the slices are
stitched with per-partition offsets. Only a group that is the first group of a
partition can continue from earlier partitions, so the offsets are one row per
partition; the partition table (first / last group per partition) is the other
broadcast. Both are bounded by the partition count (at most MAX_PARTITIONS),
never by the data.

The range partitioner samples its bounds with a seed tied to the RDD id, so
two executions of the same ``repartitionByRange`` may cut different ranges.
The partition each row lands in is therefore materialized once with a reliable
``checkpoint()`` (written to ``spark.checkpoint.dir``, so it also survives lost
executors) and every later branch reads that copy.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from tablewash.functions.names import c
from tablewash.session import ensure_checkpoint_dir


# caps the per-partition tables below (N rows, broadcast) at 100,000 rows
MAX_PARTITIONS = 100_000
# what a value of fixed width counts for, in bytes
FIXED_WIDTH = 8


def _width(name: str, dtype: DataType) -> Column:
    """Bytes that a value of the column holds, about."""
    if isinstance(dtype, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c(name)), F.lit(0)).cast("bigint")
    if isinstance(dtype, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c(name)))), F.lit(0)).cast("bigint")
    return F.lit(FIXED_WIDTH).cast("bigint")


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range partitions for the bytes that ``df`` really holds (one aggregate over its rows) at the
    advisory partition size (AQE's target). A plan's own estimate is no guide: above a join, and
    in a checkpoint of one, it multiplies the sides."""
    if num_partitions:
        return int(num_partitions)
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))
    size = df.agg(F.sum(width)).first()[0] or 0
    target = max(1, size_bytes(df.sparkSession.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")))
    return max(1, min(math.ceil(size / target), MAX_PARTITIONS))


# what a size setting may end in, and the power of two it stands for (fixed values)
SIZE_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def size_bytes(setting: str) -> int:
    """Bytes of a size setting such as ``64MB``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", setting).groups()
    return int(number) << SIZE_UNITS[unit.lower()]


def running_total(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    weight: str | Column | None = None,
    out: str = "running_total",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = running sum of ``weight`` (default 1: a row number) within
    each group in ``order_cols`` order, inclusive of the current row."""
    n = _partitions(df, num_partitions)
    group_cols = list(group_cols)
    order = [c(o) if isinstance(o, str) else o for o in order_cols]
    w = F.lit(1).cast("bigint") if weight is None else (c(weight) if isinstance(weight, str) else weight)

    gkey = F.struct(*[c(g) for g in group_cols]) if group_cols else F.lit(0)
    d = (
        df.withColumn("_tw_w", w)
        .withColumn("_tw_g", gkey)
        .repartitionByRange(n, F.col("_tw_g"), *order)
        .withColumn("_tw_pid", F.spark_partition_id())
    )
    ensure_checkpoint_dir(df.sparkSession)
    d = d.checkpoint(eager=True)

    # numbering inside one partition slice of a group: bounded by partition size
    slice_w = (
        Window.partitionBy("_tw_pid", "_tw_g")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = d.withColumn("_tw_local", F.sum("_tw_w").over(slice_w))

    # first and last group of every partition: N rows
    bounds = d.groupBy("_tw_pid").agg(F.min("_tw_g").alias("_tw_first"), F.max("_tw_g").alias("_tw_last"))
    # totals of the boundary groups only: rows are filtered to the first and
    # last group of their partition before aggregating, so the map-side partial
    # aggregate emits at most two rows per partition (2N rows in the shuffle)
    edge = (
        d.join(F.broadcast(bounds), "_tw_pid")
        .where(F.col("_tw_g").eqNullSafe(F.col("_tw_first")) | F.col("_tw_g").eqNullSafe(F.col("_tw_last")))
        .groupBy("_tw_pid", "_tw_g")
        .agg(F.sum("_tw_w").alias("_tw_tot"))
    )
    before = Window.partitionBy("_tw_g").orderBy("_tw_pid").rowsBetween(Window.unboundedPreceding, -1)
    # only the first group of a partition can continue from earlier partitions:
    # one offset row per partition, joined on the partition id
    offsets = (
        edge.select("_tw_pid", "_tw_g", F.coalesce(F.sum("_tw_tot").over(before), F.lit(0)).alias("_tw_off"))
        .join(F.broadcast(bounds), "_tw_pid")
        .where(F.col("_tw_g").eqNullSafe(F.col("_tw_first")))
        .select(F.col("_tw_pid").alias("_tw_pid2"), F.col("_tw_g").alias("_tw_g2"), "_tw_off")
    )
    joined = local.join(
        F.broadcast(offsets),
        (F.col("_tw_pid") == F.col("_tw_pid2")) & F.col("_tw_g").eqNullSafe(F.col("_tw_g2")),
        "left",
    )
    result = joined.withColumn(out, F.col("_tw_local") + F.coalesce(F.col("_tw_off"), F.lit(0)))
    return result.select(*[c(x) for x in df.columns], out)


def number_rows(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    out: str = "row_num",
    num_partitions: int | None = None,
) -> DataFrame:
    """Distributed ``row_number()`` within groups (1, 2, 3 ...)."""
    return running_total(df, group_cols, order_cols, None, out, num_partitions)


def with_row_ordinal(
    df: DataFrame, order_cols: Sequence[str | Column], out: str = "row_ordinal", num_partitions: int | None = None
) -> DataFrame:
    """Dense 1..n ordinal over the whole table in ``order_cols`` order without a
    single-partition sort."""
    return running_total(df, [], order_cols, None, out, num_partitions)


def with_file_ordinal(df: DataFrame, out: str = "row_ordinal") -> DataFrame:
    """Row order as read: file path, then the row's place in its file split.

    Uses the ``_metadata`` column of file sources, so it is deterministic under
    task retries (unlike ``monotonically_increasing_id`` after a shuffle)."""
    meta = df.select("*", F.col("_metadata.file_path").alias("_tw_f"), F.col("_metadata.file_block_start").alias("_tw_b"))
    meta = meta.withColumn("_tw_m", F.monotonically_increasing_id())
    return with_row_ordinal(meta, ["_tw_f", "_tw_b", "_tw_m"], out).drop("_tw_f", "_tw_b", "_tw_m")
