"""Token counts: rollups maintained by signed deltas, with idempotent batch commits.

A batch of changes (insert, delete, revise) becomes one signed sum of documents and tokens per
(source, language, tokenizer version): additive, so totals are the sum of all committed batches and
no document is ever read again. Changes are summed in the map tasks before they are shuffled,
so a source that holds a third of all rows costs no more than any other.

Commit: the batch's sums are written under a fresh name, then a marker file named after the
batch is created where none was (an atomic step of the file system) and names them. A
batch that has its marker is never applied again; a run that dies before it leaves files nobody reads.
``compact`` folds the committed batches into a snapshot in the same way.

Results: NULL sources, languages and versions are groups of their own; NULL counts are 0; rows
with one change_id count once within a batch (rows without one each count); groups whose sums are all
zero are left out; an unknown operation raises; other columns are ignored; an empty batch commits
nothing but its marker, and an empty store has no totals.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.llm.common import prepare

KEYS = ["source", "lang", "version"]
SUMS = "source string, lang string, version string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums of ``change_id, op, source, lang, version, n_tokens, old_tokens``: an insert adds
    a document and its tokens, a delete takes them out, a revision replaces the old count."""
    once = changes.where("change_id is not null").dropDuplicates(["change_id"]).unionByName(changes.where("change_id is null"))
    n, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("n_tokens", "old_tokens"))
    op = F.col("op")
    bad = F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("NULL"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old)
    return once.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(F.sum(docs).alias("docs"), F.sum(tokens).alias("tokens"))


class Rollups:
    """A store in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        prepare(spark)
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _markers(self, kind: str) -> dict[str, dict]:
        root = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(root):
            return {}
        paths = {s.getPath().getName(): s.getPath().toString() for s in self._fs.listStatus(root)}
        return {name: json.loads(self._read(p)) for name, p in paths.items() if not name.startswith(".")}

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _mark(self, kind: str, name: str, content: dict) -> bool:
        """Create the marker; False if there is one."""
        path = self._path(f"{self.folder}/{kind}/{name}")
        if self._fs.exists(path):
            return False
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self._fs.mkdirs(path.getParent())
        # a rename never replaces a file
        return bool(self._fs.rename(draft, path))

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/commits/{batch_id}"))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit one batch; False (and nothing happens) if it was committed before."""
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id) or batch_id.startswith((".", "_")):
            raise ValueError("batch ids are letters, digits, '-', '_' and '.'")
        if self.committed(batch_id):
            return False
        path = f"{self.folder}/sums/{uuid.uuid4().hex}"
        signed(changes).write.parquet(path)
        return self._mark("commits", batch_id, {"path": path})

    def _state(self) -> tuple[DataFrame, list[str]]:
        commits, snapshots = self._markers("commits"), self._markers("snapshots")
        last = max(snapshots.values(), key=lambda s: len(s["batches"]), default={"path": None, "batches": []})
        paths = [last["path"]] * (last["path"] is not None) + [c["path"] for b, c in commits.items() if b not in set(last["batches"])]
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), sorted(commits)

    def compact(self) -> None:
        """Fold all committed batches into one snapshot."""
        rows, batches = self._state()
        path = f"{self.folder}/sums/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._mark("snapshots", uuid.uuid4().hex, {"path": path, "batches": batches})

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens``."""
        return self._state()[0].where("docs != 0 or tokens != 0")
