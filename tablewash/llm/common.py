"""Shared helpers of the training-data operators: tables, byte batches, hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewash.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Bytes of text that the vectorised kernels hold at once (a longer text is cut at white space).
SEGMENT_BYTES = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def prepare(spark: SparkSession) -> None:
    """Package on the workers' path, checkpoint folder set."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column (case-blind, as Spark resolves) has that name."""
    used = {x.lower() for x in taken}
    while base.lower() in used:
        base += "_"
    return base


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage is cut, lost executors cost nothing."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, mod ``n`` (NULL ids count as the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def slices(texts: list, limit: int = 4 * SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` characters each; a longer text is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n + 1
    if a < len(texts):
        yield a, len(texts)


def segments(texts: list[bytes], limit: int = SEGMENT_BYTES, at_lines: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, start offsets, bytes) of pieces joined by single spaces; no word is cut,
    and with ``at_lines`` no line of under ``limit`` bytes either."""
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush():
        starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        return np.array(ids), starts, np.frombuffer(b" ".join(parts) + b" ", np.uint8)

    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > limit:
                end = t.rfind(b"\n", at + 1, at + limit) if at_lines else -1
                if end < 0:
                    m = WHITE.search(t, at + limit)
                    end = m.start() if m else len(t)
            if parts and size + end - at > limit:
                yield flush()
                ids, parts, size = [], [], 0
            ids.append(i)
            parts.append(t[at:end])
            size += end - at + 1
            at = end
    if parts:
        yield flush()


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SEGMENT_BYTES + (1 << 16))
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space)."""
    white = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(white.astype(np.int8), prepend=1))
    return edge[::2], np.append(edge, len(buf))[1::2][: (len(edge) + 1) // 2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (polynomial prefix sums, one pass over the bytes)."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the words per text."""
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for ids, offsets, buf in segments(texts):
        a, b = spans(buf)
        found.append(span_hashes(buf, a, b))
        owners.append(ids[np.searchsorted(offsets, a, side="right") - 1])
    return np.concatenate(found), np.bincount(np.concatenate(owners).astype(np.int64), minlength=len(texts))
