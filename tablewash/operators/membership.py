"""Keep list items found in a vocabulary of any size (order and repeats kept).

One path for every size: rows get a number and are stored with it once (a number made on the fly could differ
between two reads), their lists are exploded with positions, joined with the distinct words, and gathered back per
row number in position order. Rows are told apart by that number alone, so equal rows stay apart. Catalyst
broadcasts the words only while their estimated size is below its threshold; beyond it the join shuffles, with
its runtime Bloom filter dropping unknown items before the exchange and its skew handling splitting a word that
many lists hold. A gathered group is never larger than its row's own list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablewash.functions.names import c
from tablewash.session import scratch_path


def keep_known(df: DataFrame, list_col: str, vocabulary: DataFrame, key_cols: Sequence[str] = (), vocab_col: str | None = None) -> DataFrame:
    """``list_col`` reduced to the items present in ``vocabulary``; a NULL list becomes an empty one, NULL
    items go. ``key_cols`` isn't needed any more (rows are numbered)."""
    words = vocabulary.select(c(vocab_col or vocabulary.columns[0]).cast("string").alias("word")).where("word is not null").distinct()
    number = "_row"
    while number in df.columns:
        number += "_"
    path = scratch_path(df.sparkSession, "listed")
    df.withColumn(number, F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    items = rows.select(c(number).alias("row"), F.posexplode(c(list_col)).alias("pos", "word"))
    kept = items.join(words, "word", "left_semi")
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("found"))
    back = rows.join(lists, c(number) == F.col("row"), "left")
    empty = F.array().cast("array<string>")
    found = F.coalesce(F.transform("found", lambda x: x["word"]), empty)
    return back.select(*[found.alias(x) if x == list_col else c(x) for x in df.columns])
