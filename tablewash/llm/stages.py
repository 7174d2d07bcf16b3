"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``; what a filtering stage decides takes effect.
A document whose text the line dedup takes out whole leaves with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.llm import lines, near, quality as quality_field, toxicity as toxicity_model
from tablewash.functions.names import c
from tablewash.llm.common import documents, free_name, prepare, remainder, stored, table
from tablewash.llm.packing import pack


def _kept(spark: SparkSession, docs: DataFrame, model, keep) -> DataFrame:
    name = free_name(docs.columns, "_score")
    scored = toxicity_model.score(spark, docs, model, name)
    return scored.where(keep(c(name))).select(*map(c, docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Rows are judged one by one, repeated ones and those of NULL ids too. NULL, empty and blank texts get
    the score of a passage without evidence (ties at 0.5 go); texts are judged whole, at any length; an
    empty table gives no rows; all columns pass as they are, whatever their names."""
    model = toxicity_model.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return _kept(spark, docs, model, lambda s: s < 0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more.

    Rows are judged one by one, repeated ones and those of NULL ids too. NULL, empty and blank texts get
    the share of good labels as their score (a tie at 0.5 stays); texts are judged whole, at any length; an
    empty table gives no rows; all columns pass as they are, whatever their names."""
    field = quality_field.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return _kept(spark, docs, field, lambda s: s >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their later repeated runs of lines; without the documents that are nothing else.

    NULL, empty and blank texts stay as they are; equal rows (id and text) are one document and keep the
    same lines; of equal runs the one of the least id (NULL first), then text hash, then line stays; texts
    are taken whole; an empty table gives no rows; all columns pass, whatever their names."""
    lines_, gone = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_deleted")
    found = lines.dedup_lines(spark, docs, counts=(lines_, gone))
    return found.where((c(gone) == 0) | (F.expr("trim(BOTH ' \t\n\r\f' FROM text)") != "")).select(*map(c, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8: that of the smallest id (NULL ids
    last), then text hash, then place. Rows are judged one by one, also those of one id; rows
    without words (NULL, empty, blank texts) stay, all of them; texts are compared whole; an empty table
    gives no rows; all columns pass as they are, whatever their names."""
    prepare(spark)
    row = free_name(docs.columns, "_row")
    rows = stored(spark, docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = near.near_components(spark, rows.select(c(row).alias("doc_id"), "text"), k=5, percent=80)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), c(row).alias("row"))
    placed = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select(c(row).alias("row"), place.alias("place")), "row")
    keep = placed.groupBy("component_id").agg(F.min("place").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(keep, row, "left_semi").select(*map(c, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (see ``packing.pack``, also for odd texts, repeated rows and other columns)."""
    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
