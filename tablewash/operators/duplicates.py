"""Hash-first duplicates: 16-byte row digests are counted, whole rows move only where a digest repeats.

A full-row distinct shuffles every column of every row, though in a mostly unique table nearly all of that is
compared with nothing. Here

1. each row is reduced to two 64-bit hashes, and only these are grouped (with a map-side combine);
2. digests seen more than once are kept (narrow, stored once); without any, the table is returned as it is;
3. rows whose digest was seen once are unique and pass without moving (a broadcast anti join); the others
   are compared by all their columns, so equal digests of unequal rows do no harm.

Step 3 needs the repeated digests on every task. They are counted first: up to ``BROADCAST_DIGESTS`` of them
are broadcast (16 bytes each); in a table with more, most rows have to move anyway, and the plain distinct does that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewash.functions.names import c
from tablewash.operators.profile import group_expr
from tablewash.session import ensure_checkpoint_dir

BROADCAST_DIGESTS = 1 << 20


def row_digest(df: DataFrame, cols: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the row (NaN counts as NULL; places of NULLs count)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [group_expr(n, types[n]) for n in cols]
    gaps = [v.isNull() for v in values]
    return F.xxhash64(*values, *gaps), F.xxhash64(F.lit("second"), *gaps, *values)


def _digested(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = []
    for name in ("_digest_a", "_digest_b"):
        while name in [*df.columns, *names]:
            name += "_"
        names.append(name)
    return df.withColumns(dict(zip(names, row_digest(df, cols)))), names


def repeated_digests(digested: DataFrame, names: Sequence[str]) -> tuple[DataFrame, int]:
    """Digests of more than one row (stored) and how many there are."""
    ensure_checkpoint_dir(digested.sparkSession)
    found = digested.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").checkpoint()
    return found, found.count()


def distinct_rows(df: DataFrame, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """``df`` without repeated rows (NULL equals NULL; NaN must be NULL already)."""
    digested, names = _digested(df, df.columns)
    repeated, n = repeated_digests(digested, names)
    if not n:
        return df
    if n > broadcast_digests:
        return df.dropDuplicates()
    kept = [c(x) for x in df.columns]
    once = digested.join(F.broadcast(repeated), names, "left_anti").select(*kept)
    more = digested.join(F.broadcast(repeated), names, "left_semi").select(*kept).dropDuplicates()
    return once.unionByName(more)


def count_duplicates(df: DataFrame, cols: Sequence[str], broadcast_digests: int = BROADCAST_DIGESTS) -> int:
    """Rows beyond the first of each group of rows equal in ``cols``, exactly."""
    types = {f.name: f.dataType for f in df.schema.fields}
    digested, names = _digested(df.select(*[c(x) for x in cols]), cols)
    repeated, n = repeated_digests(digested, names)
    if not n:
        return 0
    rows = digested if n > broadcast_digests else digested.join(F.broadcast(repeated), names, "left_semi")
    groups = rows.groupBy(*[group_expr(x, types[x]).alias(f"k{i}") for i, x in enumerate(cols)]).agg(F.count(F.lit(1)).alias("n"))
    return int(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0])
