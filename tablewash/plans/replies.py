"""Idempotent model calls: a content-addressed store of replies with atomic batch commits.

A model call costs money and time, and Spark may run a task again: after a lost executor, for a second action, or
when the whole job is started anew. So replies are kept by what was asked: the digest of the prompt and the
attempt's number. A folder per attempt holds one Parquet file per committed batch (digest, reply):

* equal prompts are asked once: the distinct prompts of a round are scored, and the notes get their reply by digest;
* prompts that the store holds already are left out before the round (an anti join on digests);
* a task writes each batch's replies under a hidden name and renames it when it is whole. Its files carry its
  partition's name, and a retried task first reads those of its partition: it asks only what isn't in them.

So no committed prompt is sent again, whatever dies; what can be sent twice is the one batch that a task had asked and
not yet committed. A reader never sees a part of a batch, as a rename shows a file whole or not at all (local
disks, HDFS; on object stores, where a rename is a copy, the file still appears whole, as they show objects when
they are complete). Two jobs that fill one store at a time may ask the same prompt; either reply is used for all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewash.session import ship_package

SCHEMA = "digest string, reply string"
# prompts of one scorer call, and their bytes together (one prompt at least)
CALL_PROMPTS, CALL_BYTES = 2048, 1 << 23


def calls(prompts: pa.Array, batch_size: int | None = None) -> Iterator[tuple[int, int]]:
    """Begin and end of the scorer calls of a batch, so a task never holds more than a call's prompts and replies."""
    most = min(batch_size or CALL_PROMPTS, CALL_PROMPTS)
    begin = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(prompts), 0).to_pylist()):
        if i > begin and (i - begin == most or held + size > CALL_BYTES):
            yield begin, i
            begin, held = i, 0
        held += size
    if len(prompts):
        yield begin, len(prompts)


def _folder(path: str, attempt: int):
    """(file system, folder) of an attempt's files; made if it is new."""
    from pyarrow import fs

    from tablewash.sources.census import arrow_uri

    filesystem, root = fs.FileSystem.from_uri(arrow_uri(path))
    folder = f"{root}/attempt={attempt}"
    filesystem.create_dir(folder, recursive=True)
    return filesystem, folder


def committed(path: str, attempt: int, name: str) -> dict[str, str]:
    """Replies in the files of that partition's name."""
    from pyarrow import fs, parquet

    filesystem, folder = _folder(path, attempt)
    found: dict[str, str] = {}
    for info in filesystem.get_file_info(fs.FileSelector(folder)):
        if info.base_name.startswith(f"{name}-") and info.base_name.endswith(".parquet"):
            with filesystem.open_input_file(info.path) as f:
                rows = parquet.read_table(f)
            found.update(zip(rows["digest"].to_pylist(), rows["reply"].to_pylist()))
    return found


def commit(path: str, attempt: int, name: str, replies: dict[str, str]) -> None:
    """One batch, whole or not at all."""
    from pyarrow import parquet

    filesystem, folder = _folder(path, attempt)
    file = f"{name}-{uuid.uuid4().hex}.parquet"
    with filesystem.open_output_stream(f"{folder}/_{file}") as f:  # Spark passes over names with an underscore
        parquet.write_table(pa.table({"digest": list(replies), "reply": list(replies.values())}), f)
    filesystem.move(f"{folder}/_{file}", f"{folder}/{file}")


def ask(batches: Iterator[pd.DataFrame], scorer: Callable, path: str, attempt: int, name: str, batch_size: int | None = None, distinct: bool = False) -> Iterator[pd.DataFrame]:
    """Scores batches of (digest, prompt) that this partition hasn't committed yet; yields how many were sent.
    ``distinct``: no digest comes twice, so those sent need not be remembered."""
    known = set(committed(path, attempt, name))
    sent = 0
    for batch in batches:
        wanted = {d: p for d, p in zip(batch["digest"], batch["prompt"]) if d not in known}
        digests = list(wanted)
        step = batch_size or max(len(digests), 1)
        for at in range(0, len(digests), step):
            own = digests[at : at + step]
            replies = scorer([wanted[d] for d in own], attempt)
            if len(replies) != len(own):
                raise ValueError("scorer must return one reply per prompt")
            commit(path, attempt, name, {d: "" if r is None else str(r) for d, r in zip(own, replies)})
            if not distinct:
                known.update(own)
            sent += len(own)
    yield pd.DataFrame({"sent": [sent]})


def stored_replies(spark: SparkSession, path: str, attempt: int) -> DataFrame:
    """(digest, reply) of an attempt, one row per digest (the least reply, had two jobs raced)."""
    _folder(path, attempt)
    files = spark.read.schema(SCHEMA).parquet(f"{path}/attempt={attempt}")
    return files.groupBy("digest").agg(F.min("reply").alias("reply"))


def replies_of(pending: DataFrame, prompt: Column, scorer: Callable, path: str, attempt: int, tasks: int, batch_size: int | None = None) -> DataFrame:
    """``pending`` with ``reply``: distinct prompts that the store doesn't hold are scored and committed, then each row
    gets its reply by its prompt's digest."""
    spark = pending.sparkSession
    ship_package(spark)
    rows = pending.withColumn("digest", F.sha2(prompt, 256))
    # distinct by digest first: the prompt (note plus vocabulary block) is made after the shuffle
    text = [x for x in ("prompt", "text") if x in pending.columns][0]
    asked = rows.select("digest", text).dropDuplicates(["digest"]).join(stored_replies(spark, path, attempt).select("digest"), "digest", "left_anti")
    wanted = asked.repartition(tasks).select("digest", prompt.alias("prompt"))

    def run(batches):
        from pyspark import TaskContext

        # partitions of one job are told apart from those of another: their prompts may differ
        frames = (b.slice(i, j - i).to_pandas() for b in batches for i, j in calls(b.column("prompt"), batch_size))
        for sent in ask(frames, scorer, path, attempt, f"{job}-{TaskContext.get().partitionId():06d}", batch_size, distinct=True):
            yield pa.RecordBatch.from_pandas(sent, preserve_index=False)

    job = uuid.uuid4().hex[:12]
    wanted.mapInArrow(run, "sent long").agg(F.sum("sent")).collect()
    return rows.join(stored_replies(spark, path, attempt), "digest").drop("digest")
