"""Fill-in-middle transformation: cuts found by a Fenwick tree over fixed text blocks.

A text's units are its runs of A-Z and a-z and, one by one, all other code points. Two of the n + 1 places
between units are drawn from the document's id; they cut it into prefix, middle and suffix, which are
written with sentinels in psm or spm order, or the text stays plain.

1. The UTF-8 bytes of all texts of a batch are marked once: does a code point begin here, does a unit.
2. Every text is cut into blocks of ``BLOCK`` bytes. A Fenwick tree over its blocks holds the units and the
   code points that begin in them (node i sums the last ``i & -i`` blocks up to i).
3. A cut after k units goes down the tree by binary lifting: the largest power of two of blocks whose units
   all fit below k is passed over, then the next smaller one; what was passed gives the code points so far.
   All cuts of all texts of the batch go down together, one array step per level.
4. Within the block that is left the boundary is located by its marks.

So a cut costs the logarithm of the text's blocks and one block, whatever the text's length, and nothing is
split into a list of units.

Results: a NULL text counts as empty; an empty text is plain with n = 0; texts are taken whole, also over
megabytes (batches hold about ``SEGMENT_BYTES`` or one text); a NULL id is hashed as the empty
decimal; repeated rows give equal results; an empty table gives no rows; columns of ``docs`` named as the
added ones are replaced, all others pass. ``restored`` rebuilds the text from output and form alone: sentinels
can't arise across a seam, as no text with one is cut and each begins with ``<`` and ends with ``>``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewash.functions.names import c
from tablewash.llm.common import SEGMENT_BYTES, prepare

#: Bytes of a block.
BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of the documents that stay plain, and of the others that are spm.
PLAIN, SPM = 10, 20
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def marks(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where code points and units begin; ``starts``: where texts begin (no run goes across)."""
    point = (buf & 0xC0) != 0x80
    letter = _LETTER[buf]
    follows = np.zeros(len(buf), bool)
    follows[1:] = letter[1:] & letter[:-1]
    follows[starts[starts < len(buf)]] = False
    return point, point & ~follows


class Blocks:
    """Fenwick trees over the blocks of several texts that lie one after another in ``buf``."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends
        self.point, self.unit = marks(buf, starts)
        self.blocks = -(-(ends - starts) // BLOCK)
        # trees lie one after another too, each with an unused node 0
        self.base = np.cumsum(self.blocks + 1) - (self.blocks + 1)
        owner = np.repeat(np.arange(len(starts)), self.blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(self.blocks) - self.blocks, self.blocks) + 1
        begin = starts[owner] + (number - 1) * BLOCK
        node = self.base[owner] + number
        self.trees = []
        for mark in (self.unit, self.point):
            count = np.zeros(int((self.blocks + 1).sum()), np.int64)
            if len(begin):
                # what lies between blocks (nothing does) and after the last one belongs to none
                edges = np.stack([begin, np.minimum(begin + BLOCK, ends[owner])], 1).ravel()
                padded = np.append(mark, False)
                count[node] = np.add.reduceat(padded, edges, dtype=np.int64)[::2]
            total = np.cumsum(count)
            low = number & -number
            tree = np.zeros(len(count), np.int64)
            tree[node] = total[node] - total[node - low]
            self.trees.append(tree)

    def totals(self, tree: int) -> np.ndarray:
        """Sum over all blocks of each text (from the tree)."""
        out, at = np.zeros(len(self.starts), np.int64), self.blocks.copy()
        while at.any():
            out += np.where(at > 0, self.trees[tree][self.base + at], 0)
            at &= at - 1
        return out

    def descend(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each cut (after ``k`` units of ``text``): blocks passed over, units left, code points passed."""
        units, points = self.trees
        at, left, chars = np.zeros(len(k), np.int64), k.copy(), np.zeros(len(k), np.int64)
        step = 1 << int(self.blocks[text].max(initial=0)).bit_length()
        while step := step >> 1:
            ahead = at + step
            inside = ahead <= self.blocks[text]
            node = self.base[text] + np.where(inside, ahead, 0)
            take = inside & (units[node] <= left)
            at = np.where(take, ahead, at)
            left -= np.where(take, units[node], 0)
            chars += np.where(take, points[node], 0)
        return at, left, chars

    def cut(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place and code points before it, of the beginning of unit ``k`` (or the text's end)."""
        at, left, chars = self.descend(text, k)
        place = self.ends[text].copy()
        for i in np.flatnonzero(at < self.blocks[text]).tolist():
            begin = int(self.starts[text[i]] + at[i] * BLOCK)
            end = min(begin + BLOCK, int(self.ends[text[i]]))
            # unit number `left` of the block: there is one, as the whole block would have fit otherwise
            place[i] = begin + np.flatnonzero(self.unit[begin:end])[left[i]]
            chars[i] += np.count_nonzero(self.point[begin : int(place[i])])
        return place, chars


def sentinels(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts that hold a sentinel."""
    names = [x[1] for x in (PREFIX, SUFFIX, MIDDLE)]
    at = np.flatnonzero((buf[:-2] == ord("<")) & np.isin(buf[1:-1], names) & (buf[2:] == ord(">")))
    # empty texts begin where the next one does: the last text that begins there holds the place
    owner = np.searchsorted(starts, at, side="right") - 1
    held = np.zeros(len(starts), bool)
    held[owner[at + 3 <= ends[owner]]] = True
    return held


def draws(doc_id) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document's id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else int(doc_id)}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def transform(ids: list, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list]:
    """Columns ``ADDED`` of the texts ``buf[starts:ends]``."""
    blocks = Blocks(buf, starts, ends)
    n = blocks.totals(0)
    h = np.array([draws(x) for x in ids], np.int64).reshape(-1, 4)
    plain = (starts == ends) | sentinels(buf, starts, ends) | (h[:, 2] % 100 >= 100 - PLAIN)
    spm = h[:, 3] % 100 < SPM
    own = np.flatnonzero(~plain)
    first, second = h[own, 0] % (n[own] + 1), h[own, 1] % (n[own] + 1)
    a, a_chars = blocks.cut(own, np.minimum(first, second))
    b, b_chars = blocks.cut(own, np.maximum(first, second))
    raw = buf.tobytes()
    forms: list = ["plain"] * len(ids)
    prefix: list = [None] * len(ids)
    middle: list = [None] * len(ids)
    output = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
    for i, x, y, xc, yc in zip(own.tolist(), a.tolist(), b.tolist(), a_chars.tolist(), b_chars.tolist()):
        s, e = int(starts[i]), int(ends[i])
        parts = (SUFFIX, raw[y:e], PREFIX, raw[s:x]) if spm[i] else (PREFIX, raw[s:x], SUFFIX, raw[y:e])
        output[i] = b"".join((*parts, MIDDLE, raw[x:y]))
        forms[i], prefix[i], middle[i] = "spm" if spm[i] else "psm", xc, yc - xc
    return [n.tolist(), forms, prefix, middle, output]


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of about ``SEGMENT_BYTES``, each with its bytes and the texts' begins and ends there."""
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(binary):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT_BYTES, side="right")) - 1)
        stop = min(stop, len(binary))
        begin = int(offsets[at])
        yield at, stop, data[begin : int(offsets[stop])], offsets[at:stop] - begin, offsets[at + 1 : stop + 1] - begin
        at = stop


def infill(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars``
    (code points, NULL if plain) and ``output`` (the transformed text)."""
    prepare(spark)
    names = [x for x in docs.columns if x not in ADDED]
    inner = {f"x{i}": x for i, x in enumerate(names)}
    fields = ", ".join(f"{k} {docs.schema[x].dataType.simpleString()}" for k, x in inner.items())

    def run(batches):
        for batch in batches:
            ids = batch.column("own_id").to_pylist()
            for a, b, buf, starts, ends in texts_of(batch.column("own_text")):
                n, form, prefix, middle, output = transform(ids[a:b], buf, starts, ends)
                made = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.record_batch([*(batch.column(x).slice(a, b - a) for x in inner), *made], [*inner, *ADDED])

    own = docs.select(*(c(x).alias(k) for k, x in inner.items()), F.col("doc_id").cast("decimal(38,0)").alias("own_id"), F.col("text").cast("string").alias("own_text"))
    schema = ", ".join([*([fields] if fields else []), "n long, form string, prefix_chars long, middle_chars long, output string"])
    return own.mapInArrow(run, schema).toDF(*names, *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text, from ``output`` and ``form`` alone."""
    parts = F.split(output, "<[PSM]>", -1)  # '', then what follows each sentinel
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
