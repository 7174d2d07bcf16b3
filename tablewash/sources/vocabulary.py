"""Vocabulary tables (names, codes and categories the extraction may use)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Categories an extracted record may carry (fixed values).
CATEGORIES = ("push", "pull", "transfer", "balance", "stretch", "cardio", "functional")


def clean_vocabulary(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop entries lacking any required field."""
    return df.na.drop(how="any", subset=list(required))


def load_vocabulary(spark: SparkSession, workbook_path: str) -> tuple[DataFrame, DataFrame]:
    """(exercises(name, code, code_base), muscles(name_latin)) from the two
    sheets of a vocabulary workbook; empty tables when it cannot be read."""
    from tablewash.sources.workbook import read_workbook

    try:
        sheets = read_workbook(spark, workbook_path, sheets=["exercises", "muscles"], merge=False, infer=False)
        ex = clean_vocabulary(sheets["exercises"].select("name", "code", "code_base"), ["name", "code", "code_base"])
        mu = clean_vocabulary(sheets["muscles"].select("name_latin"), ["name_latin"])
        return ex, mu
    except Exception:  # noqa: BLE001 - the reference falls back to empty lists
        return (
            spark.createDataFrame([], "name string, code string, code_base string"),
            spark.createDataFrame([], "name_latin string"),
        )
