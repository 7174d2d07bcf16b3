"""Documents handed to a store exactly once: stable ids, stored batches, a log of committed ones.

A task that inserts documents into a store may die after the store took a batch and before Spark knows it; the retry
inserts the batch again. So

1. the documents are stored once with their ids: SHA-256 of the run's id and the document's place in the stored
   table. A retried task, or the whole job started anew under the same ``run_id``, sees the same documents
   with the same ids in the same batches;
2. a batch is handed to the writer unless the log holds it; when the writer returns, its count is committed under
   the batch's name (written hidden, then renamed: whole or not at all).

A committed batch is never handed out again. The one batch between the writer's return and its commit may be: its
documents carry the same ids then, so a store that inserts by id (as document stores do with ``_id``) adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.functions.names import c
from tablewash.session import ensure_checkpoint_dir, ship_package

# documents of one batch
BATCH = 1000
_LOG = "part long, batch long, written long"


def _files(path: str):
    from pyarrow import fs

    from tablewash.sources.census import arrow_uri

    filesystem, folder = fs.FileSystem.from_uri(arrow_uri(path))
    filesystem.create_dir(folder, recursive=True)
    return filesystem, folder


def batch_written(log: str, part: int, batch: int) -> bool:
    from pyarrow import fs

    filesystem, folder = _files(log)
    return filesystem.get_file_info(f"{folder}/{part}-{batch}.parquet").type == fs.FileType.File


def commit_batch(log: str, part: int, batch: int, written: int) -> None:
    import pyarrow as pa
    from pyarrow import parquet

    filesystem, folder = _files(log)
    hidden = f"{folder}/_{part}-{batch}-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(hidden) as f:
        parquet.write_table(pa.table({"part": [part], "batch": [batch], "written": [written]}), f)
    filesystem.move(hidden, f"{folder}/{part}-{batch}.parquet")


def hand_out(batches: Iterator[pd.DataFrame], writer: Callable[[Iterable], int], log: str) -> Iterator[pd.DataFrame]:
    """Rows (part, batch, pos, document) in order -> one writer call per batch that the log doesn't hold."""
    now, held, calls = None, [], 0

    def done() -> int:
        if now is None or batch_written(log, *now):
            return 0
        commit_batch(log, *now, int(writer(iter(held)) or 0))
        return 1

    for rows in batches:
        for part, batch, document in rows[["part", "batch", "document"]].itertuples(index=False):
            if (part, batch) != now:
                calls += done()
                now, held = (int(part), int(batch)), []
            held.append(document)
    calls += done()
    yield pd.DataFrame({"calls": [calls]})


def _stored_documents(spark: SparkSession, df: DataFrame, path: str, run_id: str, id_field: str) -> DataFrame:
    """part, pos, document; written by the run's first job."""
    jvm = spark._jvm  # noqa: SLF001
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # noqa: SLF001
        names = [x for x in df.columns if x != id_field]
        # the number holds the partition above its low 33 bits
        placed = df.withColumn("_place", F.monotonically_increasing_id()) if "_place" not in df.columns else None
        if placed is None:
            raise ValueError("a column is named _place")
        own = F.sha2(F.concat_ws("/", F.lit(run_id), c("_place").cast("string")), 256)
        document = F.to_json(F.struct(own.alias(id_field), *[c(x) for x in names]), {"ignoreNullFields": "false"})
        part = F.shiftright(c("_place"), 33)
        placed.select(part.alias("part"), (c("_place") - F.shiftleft(part, 33)).alias("pos"), document.alias("document")).write.mode("overwrite").parquet(path)
    return spark.read.schema("part long, pos long, document string").parquet(path)


def write_once(df: DataFrame, writer: Callable[[Iterable], int], run_id: str | None = None, id_field: str = "_id", batch_size: int = BATCH) -> int:
    """Hands every row of ``df`` to ``writer`` (an iterator of JSON texts per call, returning how many it wrote), each
    batch until it is committed; returns the documents written in all jobs of the run."""
    spark = df.sparkSession
    ship_package(spark)
    run_id = run_id or uuid.uuid4().hex
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablewash/documents-{run_id}"
    log = f"{base}/log"
    rows = _stored_documents(spark, df, f"{base}/rows", run_id, id_field).withColumn("batch", F.expr(f"pos div {int(batch_size)}"))
    # a batch is one task's, in order
    dealt = rows.repartition("part", "batch").sortWithinPartitions("part", "batch", "pos")

    def run(batches):
        yield from hand_out(batches, writer, log)

    dealt.mapInPandas(run, "calls long").agg(F.sum("calls")).collect()
    _files(log)
    return int(spark.read.schema(_LOG).parquet(log).agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0])
