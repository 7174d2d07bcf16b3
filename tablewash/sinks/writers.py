"""Sinks: CSV, Parquet, catalog table, JDBC database, JSON documents.

Every writer is a distributed Spark write (one file per partition); nothing is
gathered on the driver. ``single_file=True`` coalesces to one partition for a
human-sized export and should not be used on big tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from tablewash.functions.names import q
from tablewash.operators.sort import sort_by
from tablewash.sinks.document_log import write_once


KINDS = ("csv", "parquet", "table", "jdbc", "documents")


def _prepare(df: DataFrame, sort_col: str | None, ascending: bool, drop_columns: Iterable[str]) -> DataFrame:
    drop = [c for c in drop_columns if c in df.columns]
    out = df.drop(*drop) if drop else df
    return sort_by(out, sort_col, ascending) if sort_col else out


def write_csv(
    df: DataFrame,
    path: str,
    sort_col: str | None = None,
    ascending: bool = True,
    mode: str = "overwrite",
    single_file: bool = False,
    drop_columns: Iterable[str] = (),
) -> str:
    """Header, UTF-8, missing -> empty field. The CSV writer trims text by
    default; both whitespace options are turned off so values survive as is.
    A sorted DataFrame writes ordered part files.

    ``single_file=True`` writes exactly one file named ``path`` (as the
    reference does): the rows go through one task, so this is for
    human-sized exports only; the default writes a folder of part files."""
    out = _prepare(df, sort_col, ascending, drop_columns)
    target = f"{path}.parts" if single_file else path
    if single_file:
        out = out.coalesce(1)
    (
        out.write.mode(mode)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(target)
    )
    if single_file:
        _promote_single_part(df.sparkSession, target, path, ".csv")
    return path


def _promote_single_part(spark, folder: str, path: str, suffix: str) -> None:
    """Move the one part file of ``folder`` to ``path`` and remove the folder
    (file-system metadata operations on the driver; no data moves)."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    src_dir = jvm.org.apache.hadoop.fs.Path(folder)
    fs = src_dir.getFileSystem(conf)
    parts = [st.getPath() for st in fs.listStatus(src_dir) if st.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"expected one part file in {folder}, found {len(parts)}")
    dst = jvm.org.apache.hadoop.fs.Path(path)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst):
        fs.delete(dst, True)
    if not fs.rename(parts[0], dst):
        raise RuntimeError(f"could not move {parts[0]} to {path}")
    fs.delete(src_dir, True)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", drop_columns: Iterable[str] = (), partition_by: Iterable[str] = ()) -> str:
    out = _prepare(df, None, True, drop_columns)
    w = out.write.mode(mode)
    parts = list(partition_by)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return path


def write_table(df: DataFrame, name: str, mode: str = "overwrite", drop_columns: Iterable[str] = (), fmt: str = "parquet") -> str:
    """Full replace of a catalog table (the reference drops and re-creates); other modes write to it directly.

    The rows are written under a fresh name first, so a write that dies leaves the old table as it was (and ``df``
    may read the table that it replaces). Then the names are swapped: the old table moves aside, the new one
    takes its name, and only then the old one goes. A swap cut off in between leaves the old rows under
    the aside name; the next replace of the table, or ``recover_table``, puts them back first."""
    out = _prepare(df, None, True, drop_columns)
    spark = df.sparkSession
    if mode != "overwrite":
        out.write.mode(mode).format(fmt).saveAsTable(name)
        return name
    recover_table(spark, name)
    *database, table = _name_parts(name)
    fresh = ".".join([*map(q, database), q(f"{table}{STAGED}{uuid.uuid4().hex[:12]}")])
    aside = ".".join([*map(q, database), q(table + ASIDE)])
    quoted = ".".join(map(q, [*database, table]))
    try:
        out.write.mode("errorifexists").format(fmt).saveAsTable(fresh)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    there = spark.catalog.tableExists(quoted)
    if there:
        spark.sql(f"ALTER TABLE {quoted} RENAME TO {aside}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {quoted}")
    except BaseException:
        if there:
            spark.sql(f"ALTER TABLE {aside} RENAME TO {quoted}")
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    if there:
        spark.sql(f"DROP TABLE {aside}")
    return name


# endings of the names that a replace uses on its way
STAGED, ASIDE = "__staged_", "__aside"


def _name_parts(name: str) -> list[str]:
    """``a.b`` or ``a.`b.c``` as parts."""
    return [x[1:-1].replace("``", "`") if x.startswith("`") else x for x in re.findall(r"`(?:[^`]|``)+`|[^.`]+", name)]


def recover_table(spark, name: str) -> bool:
    """Ends a replace that was cut off between its renames: the old rows get their name back if nothing has
    it, else they go. True if the old rows were put back."""
    *database, table = _name_parts(name)
    quoted = ".".join(map(q, [*database, table]))
    aside = ".".join([*map(q, database), q(table + ASIDE)])
    if not spark.catalog.tableExists(aside):
        return False
    if spark.catalog.tableExists(quoted):
        spark.sql(f"DROP TABLE {aside}")
        return False
    spark.sql(f"ALTER TABLE {aside} RENAME TO {quoted}")
    return True


# ------------------------------------------------------------------ JDBC

DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306}
IF_EXISTS = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def jdbc_url(dialect: str, database: str, host: str = "localhost", port: int | None = None) -> str:
    """URL for sqlite (file path), postgresql or mysql."""
    d = dialect.lower()
    if d == "sqlite":
        return f"jdbc:sqlite:{database}"
    if d in DEFAULT_PORTS:
        return f"jdbc:{d}://{host}:{port or DEFAULT_PORTS[d]}/{database}"
    raise ValueError(f"database type not supported: {dialect}")


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    if_exists: str = "fail",
    user: str | None = None,
    password: str | None = None,
    batch_size: int = 10000,
    num_partitions: int | None = None,
    drop_columns: Iterable[str] = (),
) -> str:
    """Distributed JDBC write: each partition inserts in batches.
    ``if_exists``: replace | append | fail. ``num_partitions`` caps concurrent
    connections (coalesce) so a big cluster does not flood the database."""
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {tuple(IF_EXISTS)}")
    out = _prepare(df, None, True, drop_columns)
    if num_partitions:
        out = out.coalesce(num_partitions)
    props = {"batchsize": str(batch_size)}
    if user is not None:
        props["user"] = user
    if password is not None:
        props["password"] = password
    out.write.jdbc(url, table, mode=IF_EXISTS[if_exists], properties=props)
    return table


# ------------------------------------------------------------------ documents

def to_documents(df: DataFrame, drop_columns: Iterable[str] = ()) -> DataFrame:
    """One JSON document per row (column ``document``) with every field (missing ones are null)."""
    out = _prepare(df, None, True, drop_columns)
    return out.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(
    df: DataFrame,
    path: str | None = None,
    writer: Callable[[Iterable], int] | None = None,
    drop_columns: Iterable[str] = (),
    run_id: str | None = None,
    id_field: str = "_id",
) -> int:
    """Always appends; returns the number of documents written.

    With ``path``: JSON Lines files; the count is observed during the write
    job itself (``Observation``), so no second pass. With ``writer``: a
    function called once per batch with an iterator of JSON strings (e.g. a document-store bulk
    insert) returning how many it wrote. Its documents carry a stable id in ``id_field``, and a batch
    that was committed is never handed out again, by a retried task or by another job under the
    same ``run_id`` (see ``document_log``)."""
    from pyspark.sql import Observation

    if path is not None:
        obs = Observation("documents")
        to_documents(df, drop_columns).observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").text(path)
        return int(obs.get["n"])
    if writer is None:
        raise ValueError("give a path or a writer")
    return write_once(_prepare(df, None, True, drop_columns), writer, run_id, id_field)


def write_to(df: DataFrame, kind: str, **opts):
    """Dispatch by sink kind: csv | parquet | table | jdbc | documents."""
    k = kind.lower()
    if k == "csv":
        return write_csv(df, **opts)
    if k == "parquet":
        return write_parquet(df, **opts)
    if k == "table":
        return write_table(df, **opts)
    if k == "jdbc":
        return write_jdbc(df, **opts)
    if k == "documents":
        return write_documents(df, **opts)
    raise ValueError(f"unknown sink kind: {kind}; one of {KINDS}")
