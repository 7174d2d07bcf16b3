"""Corpus pipeline: ``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to
the shared checkpoint folder and reread as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewash.llm import stages
from tablewash.llm.common import documents, prepare, stored

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.toxicity),
    ("quality", stages.quality),
    ("line_dedup", stages.line_dedup),
    ("near_duplicates", stages.near_duplicates),
    ("packing", stages.packing),
]

#: Models, sketches and tokenizers have no SQL form: tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
