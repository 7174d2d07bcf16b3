"""N-gram Jaccard join: parity sketches, joined by pieces per size band, then verified.

A text's set: its distinct shingles of ``k`` words (A-Z lower-cased; with fewer words
the whole sequence). Two sets link when ``100 * intersection >= percent * union``.

1. One pass over the texts hashes the shingles. Tokens are XOR-ed into a sketch of
   ``BITS`` bits, one bit each: tokens of both sets cancel, so the Hamming distance of
   two sketches is at most the symmetric difference. For the search, the tokens are also
   dealt to ``p`` pieces and XOR-ed there. Sizes are cut into bands; in a band linked
   sets differ in at most ``d`` tokens, so at most d of p = d + 1 + s pieces differ
   and s + 1 at least agree. Empty pieces agree by chance, so a set with at most s empty
   ones leaves them out (the pair then still agrees in another piece).
   A set that may link into the next band is dealt for that band as well.
2. Equal texts are one class. Rows (piece, class) meet by piece; each class is paired
   with the first class of its piece, then with the previous one if that is in another component
   yet: that is linear in the rows.
3. Pairs pass the Hamming bound, those of large sets also that of a sketch of as many bits as the set
   has shingles (``BITS`` bits are full at about a thousand: then any two sets pass, and pairs of texts that
   merely share a passage grow with its square). Then the exact sets are compared (the pair's texts travel,
   being smaller than their sets of hashes, and become sets where they meet).
4. Components of those links. Only where a piece still holds classes of different
   components are all its cross-component pairs tried (Hamming bound inside the join),
   verified and merged, so no link between different texts that matters is lost.

Results: NULL, empty and blank texts have no shingles and link with nothing; repeated
rows are one class; a NULL id is never a component's name while its component has
another; an empty table gives no rows; other columns are ignored; texts are taken whole.
Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tablewash.llm.common import mix, prepare, slices, stored, word_hashes
from tablewash.llm.components import connected_components

BITS = 512
#: Most bits of the sketch that grows with the set (a longer set only lets more pairs pass).
FINE_BITS = 1 << 16
RATIO = 1.3
#: Classes that a task remembers in order to deal a repeated text once (a saving, not a limit).
REMEMBERED = 1 << 18
#: Bytes of texts that are verified at once.
PAIR_BYTES = 1 << 22


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, concatenated; shingles per text."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    n = len(texts)
    owner = np.repeat(np.arange(n), counts)
    h = np.zeros(len(words), np.uint64)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(begin, counts)
    for j in range(k):  # a shorter text is one shingle of all its words
        step = np.zeros(len(words), np.uint64)
        step[: max(len(words) - j, 0)] = words[j:]
        there = place + j < np.repeat(counts, counts)
        h += np.where(there, mix(step + np.uint64(j + 1)) * np.uint64(2 * j + 3), np.uint64(0))
    keep = place <= np.repeat(np.maximum(counts - k, 0), counts)
    h, owner = mix(h[keep]), owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.bincount(owner[first], minlength=n)


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top size, pieces and spare pieces of each band, up to the band after ``largest``."""
    tops, top = [], 0
    while len(tops) < 2 or tops[-2] < largest:
        top = max(top + 1, int((top + 1) * max(RATIO, 100 / percent)))
        tops.append(top)
    tops = np.array(tops, np.int64)
    d = 2 * tops * (100 - percent) // (100 + percent)
    spare = np.where(d > 0, d // 10 + 1, 0)
    return tops, d + 1 + spare, spare


def pieces(h: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece keys of each set, concatenated; keys per set."""
    tops, many, spares = bands(percent, int(counts.max(initial=0)))
    begin = np.cumsum(counts) - counts
    band = np.searchsorted(tops, counts)
    up = np.flatnonzero((counts > 0) & (counts * 100 // percent > tops[band]))
    sets = np.concatenate([np.flatnonzero(counts > 0), up])
    level = np.concatenate([band[counts > 0], band[up] + 1])
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    size, p = counts[sets], many[level]
    at = np.repeat(begin[sets], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    base = np.cumsum(p) - p
    token = h[at]
    slot = np.repeat(base, size) + ((mix(token + np.uint64(77)) >> np.uint64(20)) % np.repeat(p, size).astype(np.uint64)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, token = slot[order], token[order]
    start = np.flatnonzero(np.diff(slot, prepend=-1))
    value = np.zeros(p.sum(), np.uint64)
    value[slot[start]] = np.bitwise_xor.reduceat(token, start)
    full = np.zeros(p.sum(), bool)
    full[slot[start]] = True
    row = np.repeat(np.arange(len(sets)), p)
    empty = p - np.bincount(row[full], minlength=len(sets))
    full |= (empty > spares[level])[row]  # too many empty pieces: they count
    index = np.arange(len(row)) - base[row]
    key = mix(value ^ mix(index.astype(np.uint64) * np.uint64(4096) + level[row].astype(np.uint64) + np.uint64(1)))
    row, key = row[full], key[full]
    order = np.argsort(sets[row], kind="stable")
    return key[order].view(np.int64), np.bincount(sets[row], minlength=len(counts))


def class_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit key per set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    ends = np.cumsum(counts)
    return mix((total[ends] - total[ends - counts]) + counts.astype(np.uint64)).view(np.int64)


def fine_sketches(h: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """Sketch of each set in the power of two of bits that holds its size; None if ``BITS`` do."""
    width = np.where(counts > BITS, np.minimum(1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), FINE_BITS), 0)
    end = np.cumsum(width)
    large = np.repeat(counts > BITS, counts)
    owner = np.repeat(np.arange(len(counts)), counts)[large]
    bit = (mix(h[large] + np.uint64(991)) >> np.uint64(30)).astype(np.int64) & (width[owner] - 1)
    flips = np.bincount((end - width)[owner] + bit, minlength=int(width.sum())).astype(np.uint8) & 1
    raw = np.packbits(flips).tobytes()
    return [raw[(e - w) // 8 : e // 8] if w else None for e, w in zip(end.tolist(), width.tolist())]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, n_shingles, class key ``c`` (NULL for empty sets), ``bits`` and ``fine``."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                h, counts = shingles(texts[a:b], k)
                owner = np.repeat(np.arange(len(counts)), counts)
                bit = (mix(h + np.uint64(991)) >> np.uint64(30)).astype(np.int64) % BITS
                flips = np.bincount(owner * BITS + bit, minlength=len(counts) * BITS).astype(np.uint8) & 1
                bits = np.packbits(flips.reshape(-1, BITS), axis=1).view(np.int64)
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(counts.astype(np.int64)),
                        pa.array(class_keys(h, counts), mask=counts == 0),
                        pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), BITS // 64).cast(pa.list_(pa.int64())),
                        pa.array(fine_sketches(h, counts), pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "c", "bits", "fine"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, c long, bits array<long>, fine binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def dealt_pieces(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(piece, c) of all texts with shingles; a text that the task has just dealt is left out. They go
    straight to the exchange: making them costs less than keeping them."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                h, counts = shingles(texts[a:b], k)
                c = class_keys(h, counts)
                new = np.zeros(len(counts), bool)
                for i in np.flatnonzero(counts).tolist():
                    if c[i] not in seen:
                        seen.add(c[i])
                        new[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                key, dealt = pieces(h[np.repeat(new, counts)], np.where(new, counts, 0), percent)
                yield pa.record_batch([pa.array(key), pa.array(np.repeat(c, dealt))], ["piece", "c"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece long, c long")


def class_texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``c``, ``text`` of the wanted classes (c, doc_id of one member). Texts travel, as they are smaller
    than their sets of 64-bit hashes."""

    def run(batches):
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), np.array(batch.column("c"))
            for a, b in slices(texts):
                same = np.flatnonzero(class_keys(*shingles(texts[a:b], k)) == keys[a:b])
                yield pa.record_batch([pa.array(keys[a:b][same]), batch.column("text").slice(a, b - a).take(pa.array(same))], ["c", "text"])

    texts = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text"))
    found = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("d"))).select("c", "text").mapInArrow(run, "c long, text string")
    return found.dropDuplicates(["c"])


def near_enough(x: str, y: str, percent: int):
    """The Hamming bound, on columns named x_n, x_bits, y_n, y_bits."""
    parts = [F.bit_count(F.col(f"{x}_bits")[i].bitwiseXOR(F.col(f"{y}_bits")[i])) for i in range(BITS // 64)]
    n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
    within = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    return within & (sum(parts) * (100 + percent) <= (n + m) * (100 - percent))


def distances(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Hamming distance of each two sketches, the longer one folded to the shorter one's bits."""
    out = np.zeros(len(xs), np.int64)
    by_size: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(xs, ys)):
        by_size.setdefault((len(x), len(y)), []).append(i)
    for sizes, rows in by_size.items():
        x, y = (
            np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in rows]), np.uint8).reshape(len(rows), -1, min(sizes)), axis=1)
            for side in (xs, ys)
        )
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def finely_near(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) within the Hamming bound of their fine sketches; those without one stay."""

    def run(batches):
        for batch in batches:
            both = pc.and_(pc.is_valid(batch.column("x")), pc.is_valid(batch.column("y")))
            keep = np.ones(len(batch), bool)
            at = np.flatnonzero(both.to_numpy(zero_copy_only=False))
            size = np.asarray(pc.add(batch.column("x_n"), batch.column("y_n")), np.int64)
            step = max(1, PAIR_BYTES * 8 // FINE_BITS)
            for a in range(0, len(at), step):
                part = pa.array(at[a : a + step])
                far = distances(batch.column("x").take(part).to_pylist(), batch.column("y").take(part).to_pylist())
                keep[at[a : a + step]] = far * (100 + percent) <= size[at[a : a + step]] * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    x = known.select(F.col("c").alias("a"), F.col("n").alias("x_n"), F.col("fine").alias("x"))
    y = known.select(F.col("c").alias("b"), F.col("n").alias("y_n"), F.col("fine").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x_n", "y_n", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact sets link."""

    def run(batches):
        for batch in batches:
            size = np.cumsum(np.asarray(pc.add(pc.binary_length(batch.column("x")), pc.binary_length(batch.column("y"))), np.int64) + 1)
            at = 0
            while at < len(size):  # some megabytes of texts become Python strings at a time
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PAIR_BYTES, side="right")))
                part = batch.slice(at, end - at)
                left, right = part.column("a").to_pylist(), part.column("b").to_pylist()
                # rows come in order of a: each class is shingled once per part
                own = {**dict(zip(left, part.column("x").to_pylist())), **dict(zip(right, part.column("y").to_pylist()))}
                h, counts = shingles(list(own.values()), k)
                sets = dict(zip(own, np.split(h, np.cumsum(counts)[:-1])))
                keep = []
                for a, b in zip(left, right):
                    both = np.sort(np.concatenate([sets[a], sets[b]]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                at = end

    x = texts.select(F.col("c").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("c").alias("b"), F.col("text").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_components(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links)."""
    prepare(spark)
    base = stored(spark, sketches(docs, k), "near-sketches")
    classes = base.where("c is not null")

    # classes that share a piece; (first, previous) pairs
    by_piece = Window.partitionBy("piece").orderBy("c")
    met = dealt_pieces(docs, k, percent).select(
        "piece", "c", F.first("c").over(by_piece).alias("first"), F.lag("c").over(by_piece).alias("before"), F.lead("c").over(by_piece).alias("after")
    ).where("(before is not null and before != c) or (after is not null and after != c) or first != c")
    met = stored(spark, met.select("piece", "c", "first", "before"), "near-met")
    known = classes.join(met.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("n_shingles").alias("n"), F.min("bits").alias("bits"), F.min("fine").alias("fine"), F.min("doc_id").alias("doc_id"))
    known = stored(spark, known, "near-classes")
    x = known.select(F.col("c").alias("a"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits"))
    y = known.select(F.col("c").alias("b"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits"))
    texts = tried = parts = None

    def part_of(pairs: DataFrame, end: str) -> DataFrame:
        own = parts.select(F.col("id").alias(end), F.col("component").alias(f"p{end}"))
        return pairs.join(own, end, "left").withColumn(f"p{end}", F.coalesce(f"p{end}", end))

    def link(pairs: DataFrame) -> None:
        """Verifies the pairs that passed the Hamming bound and merges the components of those that link."""
        nonlocal texts, tried, parts
        pairs = stored(spark, finely_near(pairs, known, percent), "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        if parts is not None and pairs.isEmpty():
            return
        wanted = known.join(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct(), "c", "left_semi")
        wanted = wanted if texts is None else wanted.join(texts.select("c"), "c", "left_anti")
        wanted = stored(spark, wanted.select("c", "doc_id"), "near-wanted")  # its size is known then: few are broadcast, no text is shuffled
        more = stored(spark, class_texts(docs, wanted, k), "near-texts")
        texts = more if texts is None else texts.union(more)
        links = stored(spark, verified(pairs, texts, k, percent), "near-links")
        if parts is None:
            parts = connected_components(spark, links)
        elif not links.isEmpty():
            parts = connected_components(spark, parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))

    # with the first class of each piece: these links hold most groups together
    pairs = met.where("first != c").select(F.col("first").alias("a"), F.col("c").alias("b")).distinct()
    link(pairs.join(y, "b").join(x, "a").where(near_enough("x", "y", percent)).select("a", "b"))
    # with the previous class, where that is in another component yet
    pairs = met.where("before != c and before != first").select(F.col("before").alias("a"), F.col("c").alias("b")).distinct()
    pairs = part_of(part_of(pairs, "a"), "b").where("pa != pb").select("a", "b")
    link(pairs.join(y, "b").join(x, "a").where(near_enough("x", "y", percent)).select("a", "b"))

    # pieces whose classes are still in several components: all pairs across them
    placed = met.select("piece", "c").distinct().join(parts.withColumnRenamed("id", "c"), "c", "left").select("piece", "c", F.coalesce("component", "c").alias("part"))
    placed = stored(spark, placed, "near-placed")
    open_ = placed.groupBy("piece").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("piece")
    rest = placed.join(open_, "piece", "left_semi").join(known.select("c", "n", "bits"), "c")
    left = rest.select("piece", F.col("c").alias("a"), F.col("part").alias("pa"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits"))
    right = rest.select(F.col("piece").alias("q"), F.col("c").alias("b"), F.col("part").alias("pb"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits"))
    across = left.join(right, (F.col("piece") == F.col("q")) & (F.col("pa") < F.col("pb")) & near_enough("x", "y", percent))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    link(across.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))

    components = parts.withColumnRenamed("id", "c")
    placed = base.select("doc_id", "n_shingles", "c").join(components, "c", "left").withColumn("part", F.coalesce("component", "c"))
    names = placed.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    return placed.select("doc_id", "n_shingles", "part").join(names, "part", "left").select(
        "doc_id", "n_shingles", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )
