"""BPE encoding and decoding with a word lexicon compiled into a minimal acyclic transducer.

The words of all texts are counted (map-side sums, then one sum per word); the
most frequent ones are encoded once and compiled into a shared-suffix automaton
with id outputs (``lexicon.py``). Spark ships that file to every executor, where
the workers memory-map it. A piece that the automaton lacks is merged exactly
(``merges.py``); so the lexicon's size changes the speed, never an id.

Results: a NULL or empty text has no ids; a text may hold the vocabulary's
special strings, which become their ids; repeated rows are encoded row by row;
an empty table gives no rows; other columns are ignored. Very long texts are
taken whole (words of over 256 bytes are merged one at a time with a heap).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.llm.common import prepare, slices
from tablewash.llm.lexicon import Lexicon, compile_lexicon
from tablewash.llm.merges import ByteWords, Encoder, LowerWords, Merger, chunks

#: Words of the lexicon (a few MB): the most frequent of the whole corpus.
LEXICON_WORDS = 1 << 16
#: Longer words never enter the lexicon.
LEXICON_BYTES = 64
#: Distinct words that a counting task holds before it hands them on.
COUNTED = 1 << 18

_ENCODERS: dict[tuple, Encoder] = {}



def encoder_of(path: str, lower: bool, lexicon: str | None) -> Encoder:
    """This worker's encoder (vocabulary, mapped lexicon and remembered words outlive a task)."""
    key = (path, lower, lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        words = Lexicon(SparkFiles.get(lexicon)) if lexicon else None
        _ENCODERS[key] = Encoder(path, LowerWords() if lower else ByteWords(), words)
    return _ENCODERS[key]


def frequent_words(docs: DataFrame, n: int) -> list[str]:
    """The ``n`` most frequent words of all texts (with their leading space), most frequent first."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            rows = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for text in batch.column("text"):
                seen.update([c for c in chunks(text.as_py()) if c.isalpha()])
                if len(seen) > COUNTED:
                    yield out()
        if seen:
            yield out()

    counted = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(count, "word string, n long")
    top = (
        counted.where(F.octet_length("word") < LEXICON_BYTES)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(n)
    )
    return [" " + r["word"] for r in top.collect()]  # at most n words of at most 64 bytes


def ship_lexicon(spark: SparkSession, docs: DataFrame, path: str, n: int) -> str:
    """Compile the lexicon and hand it to all executors; returns its file name there."""
    words = sorted({w.encode() for w in frequent_words(docs, n)})
    ids, counts = Merger(path).merge(words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(tempfile.mkdtemp(prefix="tablewash-lexicon-"), name)
    compile_lexicon(words, np.split(ids.astype(np.int64), np.cumsum(counts)[:-1]) if words else [], file)
    spark.sparkContext.addFile(file)
    return name


def encode(
    spark: SparkSession, docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, decoded: bool = False
) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers) and, on demand, ``decoded``
    (UTF-8 of the text that the ids give back), one row for each row of ``docs``.

    ``path``: a byte-level BPE vocabulary file, at the same place on every machine."""
    prepare(spark)
    lexicon = ship_lexicon(spark, docs, path, lexicon_words)

    def run(batches):
        own = encoder_of(path, False, lexicon)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = own.encode(texts[a:b])
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.large_binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.large_binary()))
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary" + ", decoded binary" * decoded
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` of the ids (NULL ids: empty)."""
    prepare(spark)

    def run(batches):
        own = encoder_of(path, False, None)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for a, b in slices(ids):
                texts = [own.decode(x or b"").decode() for x in ids[a:b]]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
