import pytest

from tablewash.plans.recipe import Recipe
from tablewash.streaming import NotStreamable, apply_recipe_stream, start_parquet_sink


def test_row_wise_recipe_on_stream(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(" a ", 0.0), ("B", 2.0), ("c", 0.0)], "s string, x double").write.parquet(str(src))
    stream = spark.readStream.schema("s string, x double").parquet(str(src))
    r = (Recipe().record("replace_zeros", {"columns": ["x"]}).record("handle_missing", {"method": "fill", "fill_value": 9})
         .record("trim_whitespace", {}).record("standardize_case", {"case": "uppercase"}))
    out = apply_recipe_stream(stream, r)
    assert out.isStreaming
    q = start_parquet_sink(out, str(tmp_path / "sink"), checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "sink")).collect())
    assert rows == [("A", 9.0), ("B", 2.0), ("C", 9.0)]


def test_whole_table_steps_refused(spark, tmp_path):
    src = tmp_path / "src2"
    spark.createDataFrame([(1.0,)], "x double").write.parquet(str(src))
    stream = spark.readStream.schema("x double").parquet(str(src))
    with pytest.raises(NotStreamable):
        apply_recipe_stream(stream, Recipe().record("handle_missing", {"method": "fill", "fill_value": "mean"}))
    with pytest.raises(NotStreamable):
        apply_recipe_stream(stream, Recipe().record("remove_duplicates", {"remove": "yes"}))


def test_stream_dedup_within_watermark(spark, tmp_path):
    src = tmp_path / "src3"
    spark.createDataFrame(
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:05")],
        "s string, ts string",
    ).selectExpr("s", "CAST(ts AS TIMESTAMP) AS ts").write.parquet(str(src))
    stream = spark.readStream.schema("s string, ts timestamp").parquet(str(src))
    out = apply_recipe_stream(stream, Recipe().record("remove_duplicates", {"remove": "yes"}), event_time="ts",
                              watermark="1 minute")
    q = start_parquet_sink(out, str(tmp_path / "sink3"), checkpoint_location=str(tmp_path / "ckpt3"))
    q.awaitTermination(120)
    assert sorted(r["s"] for r in spark.read.parquet(str(tmp_path / "sink3")).collect()) == ["a", "b"]
