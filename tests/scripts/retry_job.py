"""Run jobs whose tasks fail on their first attempt (local[4,3]: up to 3
attempts per task) and print a JSON summary. Used by tests/test_retries.py."""

import json
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession, Window, functions as F  # noqa: E402

from tablewash.operators.sequence import number_rows  # noqa: E402
from tablewash.plans import extract  # noqa: E402
from tablewash.session import ensure_checkpoint_dir, ship_package  # noqa: E402

spark = (
    SparkSession.builder.master("local[4,3]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", sys.argv[1])
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
ensure_checkpoint_dir(spark)
ship_package(spark)


def flaky(batches):
    """Identity, but every task's first attempt dies after reading its input."""
    rows = list(batches)
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("simulated lost executor")
    yield from rows


df = spark.range(0, 3000).select(
    F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 17).cast("string")).alias("g"),
    (F.col("id") * 7919 % 3000).alias("o"),
).repartition(4)
flaky_df = df.mapInPandas(flaky, df.schema)
got = number_rows(flaky_df, ["g"], ["o"], out="n", num_partitions=5)
want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")))
numbering_ok = got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def scorer(prompts, attempt):
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("simulated lost executor during a model call")
    return [json.dumps([{"exercise_name": extract.note_of(p), "code": "X"}]) for p in prompts]


notes = spark.createDataFrame([(i, f"S{i % 5}", f"note {i}") for i in range(40)], "i int, session string, exercise string")
out = extract.extract_table(notes, scorer, ["i"], num_tasks=4)
rows = sorted((r["session"], r["exercise_num"], r["exercise_name"]) for r in out.collect())
expected = sorted(
    (f"S{s}", k + 1, f"note {i}") for s in range(5) for k, i in enumerate(sorted(j for j in range(40) if j % 5 == s))
)
print(json.dumps({"numbering_ok": numbering_ok, "extraction_ok": rows == expected, "rows": len(rows)}))
spark.stop()
