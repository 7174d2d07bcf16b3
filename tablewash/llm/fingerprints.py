"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are its runs of ``K`` words, each with its occurrence number (the second "of the"
differs from the first). A hash of both deals them to ``BINS`` bins; in each bin the ``PICKED`` with
the least hashes are selected, put back in text order, and hashed as a tuple. So a bin of two
texts agrees if both select the same k-mers in the same order: likeness falls with the edit
distance, not only with the words in common. Likeness: the share of bins that agree among those
that either text fills (two texts without words: 1).

Everything is per row: words are hashed, sorted as packed 64-bit integers (hash, place), numbered
within their runs, hashed and sorted again. The next document is found on ids alone (range
partitions; only their first ids, one per task, meet in one place), and texts then move by id.

Results: NULL texts count as empty; an empty or blank text has an empty fingerprint; rows of equal id and text
are one place in the order and get equal results; NULL ids come first, and rows of one id follow by text hash; a
single document is its own next; an empty table gives no rows; other columns are ignored; texts
of up to 67 million words are told apart word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tablewash.llm.common import prepare, stored

K, BINS, PICKED = 2, 64, 2
PLACE = (1 << 26) - 1  # low bits: place in the text
HASH = -(1 << 26)  # high bits
BIN = 58  # bits below the bin number
EMPTY = "----"
NO_ID = -(1 << 63)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and ``name``: array of ``BINS`` tuple hashes as text (EMPTY for an empty bin)."""
    def step(sql: str, column: str):
        nonlocal df
        df = df.withColumn(column, F.expr(sql))

    w, s, st, q, b = (f"_{name}_{x}" for x in ("words", "sorted", "starts", "kmers", "bins"))
    step(rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), x -> x != '')", w)
    kmer = ", ".join(f"get({w}, i + {j})" for j in range(K))
    step(f"if(size({w}) = 0, array(), sort_array(transform(sequence(0, greatest(size({w}) - {K}, 0)), i -> (xxhash64({kmer}) & {HASH}L) | i)))", s)
    step(f"if(size({s}) = 0, array(), filter(sequence(0, size({s}) - 1), i -> i = 0 or ({s}[i] & {HASH}L) != ({s}[i - 1] & {HASH}L)))", st)
    numbered = f"(xxhash64({s}[a] & {HASH}L, j - a) & {HASH}L) | ({s}[j] & {PLACE}L)"
    step(f"sort_array(flatten(transform({st}, (a, r) -> transform(sequence(a, coalesce(get({st}, r + 1), size({s})) - 1), j -> {numbered}))))", q)
    bin_of = f"shiftrightunsigned({q}[i], {BIN})"
    step(f"if(size({q}) = 0, array(), filter(sequence(0, size({q}) - 1), i -> i = 0 or {bin_of} != shiftrightunsigned({q}[i - 1], {BIN})))", b)
    picked = f"filter(slice({q}, i + 1, {PICKED}), x -> shiftrightunsigned(x, {BIN}) = {bin_of})"
    in_order = f"transform(array_sort(transform({picked}, x -> struct(x & {PLACE}L as place, shiftrightunsigned(x, 26) as kmer))), x -> x.kmer)"
    entry = f"struct(cast({bin_of} as int) as bin, right(hex(xxhash64({in_order})), {len(EMPTY)}) as h)"
    step(f"map_from_entries(transform({b}, i -> {entry}))", b + "m")
    # named twice, so that the optimizer doesn't move the map into the loop over the bins
    step(f"if(size({b}m) = 0, array_repeat('{EMPTY}', {BINS}), transform(sequence(0, {BINS - 1}), n -> coalesce({b}m[n], '{EMPTY}')))", name)
    return df.drop(w, s, st, q, b, b + "m")


def likeness(x: Column | str, y: Column | str) -> Column:
    """Share of agreeing bins among those that either fingerprint fills."""
    pairs = F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))
    filled = F.size(F.filter(pairs, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != EMPTY) & (p["x"] == p["y"])))
    return F.when(filled == 0, 1.0).otherwise(same / filled)


def next_places(spark: SparkSession, places: DataFrame) -> DataFrame:
    """``places`` (distinct d, h; any more columns) with the next place's ``nd, nh`` in order (the first after the last)."""
    tasks = max(1, -(-places.count() // (1 << 20)), spark.sparkContext.defaultParallelism)
    cut = stored(spark, places.repartitionByRange(tasks, "d", "h").withColumn("part", F.spark_partition_id()), "places")
    # one row per task: the first place of each range and of the range after it
    firsts = cut.groupBy("part").agg(F.min(F.struct("d", "h")).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"), F.first("first").over(Window.orderBy("part")).alias("begin"))
    firsts = firsts.select("part", F.coalesce("after", "begin").alias("after"))
    within = F.lead(F.struct("d", "h")).over(Window.partitionBy("part").orderBy("d", "h"))
    found = cut.withColumn("next", within).join(F.broadcast(firsts), "part")
    return found.withColumn("next", F.coalesce("next", "after")).select(*places.columns, F.col("next.d").alias("nd"), F.col("next.h").alias("nh"))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; the
    edited text has its last half replaced by the beginning of the next document's."""
    prepare(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the id is kept in d alone, so that both joins below read one and the same exchange of the texts
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    places = next_places(spark, own.groupBy("d", "h").agg(F.max(F.length("text")).alias("n")))
    places = stored(spark, places, "next-places")
    # the beginning of each place's next text, as long as half of the place's own
    wanted = places.select("nd", "nh", F.col("d").alias("od"), F.col("h").alias("oh"), "n")
    heads = own.join(wanted, (F.col("d") == F.col("nd")) & (F.col("h") == F.col("nh")))
    heads = heads.select(F.col("od").alias("d"), F.col("oh").alias("h"), "nd", "nh", F.expr("substring(text, 1, cast(n div 2 as int))").alias("head"))
    whole = own.join(heads.dropDuplicates(["d", "h"]), ["d", "h"])
    n = F.length("text")
    whole = whole.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))"), "head"))
    whole = whole.select(F.when(F.col("d") != NO_ID, F.col("d")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "d", "h", "nd", "nh", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    made = with_fingerprint(with_fingerprint(whole, "text", "f").drop("text"), "edited", "e").drop("edited")
    made = stored(spark, made, "fingerprints")
    after = made.select(F.col("d").alias("nd"), F.col("h").alias("nh"), F.col("f").alias("g")).dropDuplicates(["nd", "nh"])
    return made.join(after, ["nd", "nh"]).select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("f", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"), likeness("f", "g").alias("near_next"),
    )
