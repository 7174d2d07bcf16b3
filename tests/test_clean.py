import math

import pytest
from pyspark.sql import functions as F

from tablewash.operators import casts, clean


def col(df, name):
    return [r[name] for r in df.collect()]


def test_replace_zeros_all(sample_df):
    out = clean.replace_zeros(sample_df, "all")
    assert col(out, "pallets") == [None, 14, 14, 3, None, 21]
    assert col(out, "kilos").count(None) == 2 and col(out, "sealed").count(False) == 3
    assert dict(out.dtypes)["pallets"] == "bigint"


def test_replace_zeros_named_and_none(sample_df):
    out = clean.replace_zeros(sample_df, ["kilos"])
    assert col(out, "kilos").count(None) == 2
    assert col(out, "pallets").count(0) == 2
    # text never equals the number 0
    assert col(clean.replace_zeros(sample_df.selectExpr("'0' as t", "pallets"), ["t", "pallets"]), "t") == ["0"] * 6
    assert clean.replace_zeros(sample_df, "none") is sample_df
    assert clean.replace_zeros(sample_df, None) is sample_df


def test_replace_zeros_skips_keys_and_booleans(spark):
    df = spark.createDataFrame([(0, 0, False), (1, 2, True)], "k bigint, v bigint, b boolean")
    out = clean.replace_zeros(df, "all", key_columns=["k"])
    assert col(out, "k") == [0, 1] and col(out, "v") == [None, 2] and col(out, "b") == [False, True]


def test_unknown_column_refused(sample_df):
    with pytest.raises(ValueError):
        clean.replace_zeros(sample_df, ["nope"])


def test_drop_rows_any(df_with_missing):
    assert clean.drop_rows_any(df_with_missing).count() == 1


def test_drop_rows_counts_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert clean.drop_rows_any(df).count() == 1


def test_drop_cols_any(df_with_missing):
    assert clean.drop_cols_any(df_with_missing).columns == ["sea"]


def test_fill_literal_text(df_with_missing):
    out = clean.handle_missing(df_with_missing, "fill", "unknown")
    assert col(out, "station") == ["K1", "unknown", "K3", "K4"]
    # depth has a missing value and 'unknown' is not a number: widened to text
    assert dict(out.dtypes)["depth"] == "string"
    assert col(out, "depth") == ["4.5", "7.0", "unknown", "9.25"]


def test_fill_literal_skip_keeps_numeric(df_with_missing):
    out = clean.fill_literal(df_with_missing, "unknown", on_mismatch="skip")
    assert dict(out.dtypes)["salinity"] == "double"
    assert col(out, "salinity")[0] is None


def test_fill_literal_typed(df_with_missing):
    out = clean.fill_literal(df_with_missing, 7)
    assert col(out, "depth") == [4.5, 7.0, 7.0, 9.25]
    assert col(out, "station") == ["K1", "7", "K3", "K4"]


def test_fill_literal_keeps_fractions(spark):
    df = spark.createDataFrame([(1, 5), (None, 6)], "a bigint, b bigint")
    out = clean.fill_literal(df, 12.7)
    assert col(out, "a") == [1.0, 12.7] and dict(out.dtypes) == {"a": "double", "b": "bigint"}


@pytest.mark.parametrize("method", ["mean", "median"])
def test_fills_leave_whole_columns_alone(spark, method):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1), (big + 2, None)], "id bigint, v bigint")
    out = clean.handle_missing(df, "fill", method)
    assert dict(out.dtypes) == {"id": "bigint", "v": "double"}
    assert col(out, "id") == [big, big + 2] and col(out, "v") == [1.0, 1.0]


def test_keyed_duplicates_with_a_missing_key(spark):
    df = spark.createDataFrame([(None, "b"), (2, "a"), (1, "a")], "k bigint, v string")
    out = sorted((tuple(r) for r in clean.remove_duplicates(df, key_columns=["k"]).collect()), key=repr)
    assert out == [(1, "a"), (None, "b")]


def test_ambiguous_and_broken_dates(spark):
    rows = [(1, "01/02/2020", "01/02/2020"), (2, "03/04/2020", "13/02/2020")]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    for parts in (1, 2, 7):  # the same answer however the rows lie
        refusals = {}
        out = casts.fix_types(df.repartition(parts), {"a": "datetime", "b": "datetime"}, order_cols=["n"], refusals=refusals)
        assert sorted(str(x) for x in col(out, "a")) == ["2020-01-02 00:00:00", "2020-03-04 00:00:00"]
        assert dict(out.dtypes)["b"] == "string"  # month first by the first value: the second breaks it
        assert refusals == {"b": "13/02/2020"}
        # without an order, the first format that reads all values: day first
        out = casts.fix_types(df.repartition(parts), {"b": "datetime"})
        assert sorted(str(x) for x in col(out, "b")) == ["2020-02-01 00:00:00", "2020-02-13 00:00:00"]


def test_datetime_format_choice_edges(spark):
    df = spark.createDataFrame([(1, None, None, "2020-01-05"), (2, None, "x", "05/01/2020"), (3, None, "y", None)], "n int, a string, b string, c string")
    found = casts.judge_datetime_formats(df, ["a", "b", "c"], order_cols=["n"])
    assert not found["a"].refused  # nothing breaks an empty column
    assert (found["b"].refused, found["b"].broken_by) == (True, "x")
    assert (found["c"].refused, found["c"].broken_by) == (True, "05/01/2020")
    assert casts.choose_datetime_formats(df, ["c"]) == {}
    refusals = {}
    out = casts.fix_types(df, {"b": "int", "n": "str"}, refusals=refusals)
    assert refusals == {"b": "x"} and dict(out.dtypes)["n"] == "string"


def test_long_ids_and_codes_stay_text(spark):
    df = spark.createDataFrame([("12345678901234567890123", "1D", "1e3"), ("12345678901234567890124", "2F", "2.5")], "a string, b string, c string")
    out = casts.infer_types(df)
    assert dict(out.dtypes) == {"a": "string", "b": "string", "c": "double"}
    assert col(casts.fix_types(df, {"b": "float"}, mode="coerce"), "b") == [None, None]


def test_fill_literal_untouched_column_keeps_type(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, "a")], "x double, s string")
    out = clean.fill_literal(df, "z")
    assert dict(out.dtypes)["x"] == "double"
    assert col(out, "s") == ["z", "a"]


def test_fill_mean_median_mode(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (2.0, "b"), (None, "b"), (10.0, None), (2.0, "a")], "x double, s string"
    )
    assert col(clean.fill_mean(df), "x")[2] == pytest.approx(15.0 / 4)
    assert col(clean.fill_median(df), "x")[2] == 2.0
    mode = clean.fill_mode(df)
    assert col(mode, "x")[2] == 2.0
    assert col(mode, "s")[3] == "a"  # a and b tie: lowest wins


def test_fill_median_even_count_and_ints(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x bigint")
    out = clean.fill_median(df)
    assert dict(out.dtypes)["x"] == "double"
    assert col(out, "x")[4] == 2.5


def test_fill_no_missing_is_identity(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "a bigint")
    for method in ("mean", "median", "mode"):
        assert sorted(col(clean.handle_missing(df, "fill", method), "a")) == [1, 2, 3]


def test_unknown_method_raises(sample_df):
    with pytest.raises(ValueError):
        clean.handle_missing(sample_df, "explode")


def test_remove_duplicates(sample_df, spark):
    assert clean.remove_duplicates(sample_df).count() == 4
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "k bigint, v string")
    assert clean.remove_duplicates(df).count() == 3  # missing == missing only across whole rows
    kept = clean.remove_duplicates(df, key_columns=["k"]).orderBy("k")
    assert [tuple(r) for r in kept.collect()] == [(1, None), (3, "x")]


def test_remove_duplicates_arrays_and_maps(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}), ([1, 2], {"a": 1}), ([2], {"a": 1})], "l array<int>, m map<string,int>")
    assert clean.remove_duplicates(df).count() == 2


def test_trim_and_case(sample_df):
    t = clean.trim_text(sample_df)
    assert col(t, "goods") == ["Tin sheets", "cork", "cork", "Glass wool", "Tin sheets", "oak planks"]
    assert set(col(t, "bay")) == {"Bay 9", "Bay 2", "Bay 4"}
    assert col(clean.standardize_case(t, "lowercase"), "goods")[3] == "glass wool"
    assert col(clean.standardize_case(t, "uppercase"), "bay")[5] == "BAY 2"
    assert clean.standardize_case(t, "none") is t
    with pytest.raises(ValueError):
        clean.standardize_case(t, "sponge")


def test_cast_types(sample_df, spark):
    out = casts.fix_types(sample_df, {"pallets": "str"})
    assert col(out, "pallets")[5] == "21"
    df = spark.createDataFrame([(" 12 ", 1.9, "2024-01-05"), ("7", -1.9, "2024-02-01")], "a string, b double, d string")
    out = casts.fix_types(df, {"a": "int", "b": "int", "d": "datetime"})
    assert col(out, "a") == [12, 7] and col(out, "b") == [1, -1]
    assert str(col(out, "d")[0]) == "2024-01-05 00:00:00"


def test_cast_guard_refuses_column(spark):
    df = spark.createDataFrame([("12.5", "3"), ("4", "5")], "a string, b string")
    out = casts.fix_types(df, {"a": "int", "b": "int"})
    assert dict(out.dtypes) == {"a": "string", "b": "bigint"}
    coerced = casts.fix_types(df, {"a": "int"}, mode="coerce")
    assert col(coerced, "a") == [None, 4]


def test_cast_datetime_formats_and_epoch(spark):
    df = spark.createDataFrame([("05/01/2024", 1_700_000_000_123_456_789)], "d string, ns bigint")
    out = casts.fix_types(df, {"d": "datetime", "ns": "datetime"})
    r = out.first()
    assert str(r["d"]) == "2024-05-01 00:00:00"
    assert r["ns"].isoformat().endswith("22:13:20.123456")


def test_infer_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "True", "NA", "x"), ("2", "n/a", "false", "", "y")], "a string, b string, c string, d string, e string"
    )
    out = casts.infer_types(casts.na_to_null(df))
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    assert col(out, "c") == [True, False]


def test_fill_median_approx(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 100)] + [(None,)], "x double")
    out = clean.fill_median(df, approx=True)
    assert [r[0] for r in out.collect()][-1] == 50.0


@pytest.mark.parametrize("text", ["12.0", " 12 ", "1e3", "+5", "12.5", "0x10", "-7", "1_000"])
def test_text_to_int_follows_python_int(spark, text):
    try:
        want = int(text) if "_" not in text else None  # S-6: underscores refused on purpose
    except ValueError:
        want = None
    df = spark.createDataFrame([(text,)], "a string")
    got = casts.fix_types(df, {"a": "int"}, mode="coerce").first()["a"]
    assert got == want


@pytest.mark.parametrize("text", ["1.5", " 2.25 ", "1e3", "-0.5", "inf", "abc", "0x10", "nan"])
def test_text_to_float_follows_python_float(spark, text):
    try:
        want = float(text)
        want = None if math.isnan(want) else want  # NaN becomes missing
    except ValueError:
        want = None
    df = spark.createDataFrame([(text,)], "a string")
    got = casts.fix_types(df, {"a": "float"}, mode="coerce").first()["a"]
    assert got == want


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_hash_first_duplicates(spark, monkeypatch, collide, limit):
    """Exact also where all digests are equal, or too many repeat for a broadcast."""
    from tablewash.operators import duplicates

    if collide:
        monkeypatch.setattr(duplicates, "row_digest", lambda df, cols: (F.lit(1), F.lit(2)))
    rows = [("a", 1.0, [1]), ("a", 1.0, [1]), (None, None, None), (None, None, None), (None, float("nan"), None), ("a", None, [1]), (None, 1.0, [1]), ("b", -0.0, []), ("b", 0.0, []), ("c", 2.0, [1, None])]
    df = spark.createDataFrame(rows, "s string, `_digest_a` double, `x.y` array<int>").repartition(4)
    plain = clean.remove_duplicates(df)
    assert clean.duplicate_rows(df) == 4 == df.count() - plain.count()
    assert clean.duplicate_rows(df, ["s"]) == 5
    got = duplicates.distinct_rows(clean.normalize_nan(df), limit)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert duplicates.count_duplicates(df, df.columns, limit) == 4
    assert duplicates.distinct_rows(df.limit(0), limit).count() == 0


def test_hash_first_moves_few_rows(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 20, F.lit(0)).otherwise(F.col("id")).alias("k"), F.repeat(F.col("id").cast("string"), 0).alias("t"))
    plan = clean.remove_duplicates(df, hash_first=True)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1  # the repeated rows alone
    unique = spark.range(100).withColumn("t", F.lit("x"))
    assert "Exchange" not in clean.remove_duplicates(unique, hash_first=True)._jdf.queryExecution().executedPlan().toString()
