import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tablewash.operators import stats
from tablewash.operators.sequence import number_rows, running_total, with_row_ordinal


def test_number_rows_matches_window_with_hot_group(spark):
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 11).cast("string")).alias("g"),
        (F.col("id") * 7919 % 4000).alias("o"),
    )
    a = number_rows(df, ["g"], ["o"], out="n", num_partitions=13)
    b = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_row_ordinal_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("k"))
    out = with_row_ordinal(df, ["k"], num_partitions=7)
    got = {r["k"]: r["row_ordinal"] for r in out.collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_running_total_weights_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5), ("a", 3, 1)], "g string, o int, w int")
    out = {(r["g"], r["o"]): r["cum"] for r in running_total(df, ["g"], ["o"], weight="w", out="cum", num_partitions=3).collect()}
    assert out == {(None, 1): 2, (None, 2): 5, ("a", 1): 5, ("a", 3): 6}


def test_median_mode_match_pandas(spark):
    import random

    rnd = random.Random(7)
    rows = [(rnd.choice([None, rnd.randint(0, 50)]), rnd.choice(["x", "y", None, "z"]), rnd.random()) for _ in range(777)]
    df = spark.createDataFrame(rows, "a bigint, s string, f double")
    p = pd.DataFrame(rows, columns=["a", "s", "f"])
    med = stats.medians(df, ["a", "f"]).first()
    assert med["a"] == p["a"].median() and abs(med["f"] - p["f"].median()) < 1e-12
    mode = stats.modes(df, ["a", "s", "f"]).first()
    assert mode["a"] == p["a"].mode().iloc[0] and mode["s"] == p["s"].mode().iloc[0]
    assert mode["f"] == p["f"].mode().iloc[0]


def test_stats_all_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert stats.medians(df, ["a"]).first()["a"] is None
    assert stats.modes(df, ["a"]).first()["a"] is None


def test_partitions_follow_the_bytes_held(spark):
    """Rows of a checkpointed join are counted, not estimated (the estimate multiplies the sides)."""
    from tablewash.operators.sequence import _partitions, size_bytes

    notes = spark.range(5360).selectExpr("id", "id % 7 as k", "repeat('a', 100) as text")
    joined = notes.join(notes.groupBy("k").count(), "k").join(notes.groupBy("k").count().withColumnRenamed("count", "n"), "k").checkpoint()
    assert _partitions(joined, None) == 1
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        few, many = _partitions(joined.limit(1000), None), _partitions(joined, None)
        assert 1 < few < many <= 5360 * 140 // 65536 + 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert _partitions(joined.limit(0), None) == 1
    assert [size_bytes(x) for x in ("64MB", "8m", " 512 kb", "17", "2g")] == [64 << 20, 8 << 20, 512 << 10, 17, 2 << 30]


@pytest.mark.parametrize("listed", [1 << 15, 2])
def test_median_by_refinement(spark, monkeypatch, listed):
    """Heavy tails, hot values, signs, zeros, infinities, tiny and huge numbers, with and without the list."""
    import random
    import statistics

    from tablewash.operators import stats

    monkeypatch.setattr(stats, "LISTED", listed)
    rng = random.Random(3)
    cols = {
        "tails": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(999)],
        "even": [rng.gauss(0, 1) for _ in range(1000)],
        "hot": [7.25] * 600 + [rng.random() for _ in range(400)],
        "two": [1.0] * 500 + [2.0] * 500,
        "apart": [-5.0] * 500 + [3.5] * 500,
        "close": [1 + i * 2**-52 for i in range(1000)],
        "zeros": [0.0, -0.0] * 500,
        "tiny": [5e-324 * i for i in range(1000)],
        "wide": [-1.7e308, 1.7e308] * 499 + [1.5, 2.5],
        "ends": [float("-inf")] * 10 + [float("inf")] * 10 + [float(i) for i in range(980)],
        "signs": [float(i - 500) for i in range(1000)],
        "few": [3.0, None, float("nan"), 4.0],
        "one": [None, -2.5],
        "none": [None, float("nan")],
    }
    n = max(map(len, cols.values()))
    rows = list(zip(*[v + [None] * (n - len(v)) for v in cols.values()]))
    rng.shuffle(rows)
    got = stats.medians(spark.createDataFrame(rows, ", ".join(f"{k} double" for k in cols)), list(cols)).first()
    for k, values in cols.items():
        there = [x for x in values if x is not None and x == x]
        assert got[k] == (statistics.median(there) if there else None), k
    whole = spark.range(101).select((F.col("id") * 1000).alias("a.b"))
    assert stats.medians(whole, ["a.b"]).first()[0] == 50_000.0
    assert stats.medians(whole.limit(0), ["a.b"]).first()[0] is None
