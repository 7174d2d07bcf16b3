import json

import pytest

from tablewash.plans.recipe import Recipe, clean_table


def test_record_get_has():
    r = Recipe().record("standardize_case", {"case": "titlecase"}).record("fix_types", {"conversions": {"kilos": "int"}})
    again = r.record("standardize_case", {"case": "lowercase"})
    assert again.get("standardize_case") == {"case": "titlecase"} and len(again.steps) == 3 and len(r.steps) == 2
    assert again.has("fix_types") and not again.has("handle_missing") and again.get("handle_missing") is None


def test_save_load_roundtrip(tmp_path):
    r = (
        Recipe()
        .record("fix_types", {"conversions": {"pallets": "float"}, "mode": "coerce"})
        .record("handle_missing", {"method": "drop_cols"})
    )
    p = tmp_path / "sub" / "recipe.json"
    r.save(str(p))
    data = json.loads(p.read_text(encoding="utf-8"))
    assert set(data) == {"created_at", "steps"} and data["steps"][1] == {"step": "handle_missing", "params": {"method": "drop_cols"}}
    back = Recipe.load(str(p))
    assert back == r


def test_clean_fixed_order_and_replay(sample_df):
    out, recipe = clean_table(sample_df, zeros=["pallets"], missing=("fill", "mean"), remove_duplicates=True, case="uppercase")
    rows = sorted(tuple(x) for x in out.collect())
    assert rows == [
        ("CORK", 14.0, "BAY 2", 0.0, False), ("GLASS WOOL", 3.0, "BAY 4", 77.0, True),
        ("OAK PLANKS", 21.0, "BAY 2", 310.5, False), ("TIN SHEETS", 13.0, "BAY 9", 120.25, True),
    ]
    replayed = Recipe.loads(recipe.dumps()).apply(sample_df)
    assert sorted(tuple(x) for x in replayed.collect()) == rows
    assert [s.step for s in recipe.steps] == ["replace_zeros", "handle_missing", "remove_duplicates", "trim_whitespace", "standardize_case"]


def test_replay_always_trims_all_text(spark):
    df = spark.createDataFrame([(" a ", " b ")], "x string, y string")
    for r in (Recipe(), Recipe().record("trim_whitespace", {"columns": ["x"]})):
        assert tuple(r.apply(df).first()) == ("a", "b")


def test_duplicates_removed_before_trim(spark):
    df = spark.createDataFrame([("a ",), ("a",)], "s string")
    out, _ = clean_table(df, remove_duplicates=True)
    assert out.count() == 2  # equal only after trimming: both survive, as in the fixed order


def test_replay_recomputes_statistics(spark):
    r = Recipe().record("handle_missing", {"method": "fill", "fill_value": "mean"})
    a = spark.createDataFrame([(1.0,), (None,)], "x double")
    b = spark.createDataFrame([(10.0,), (None,)], "x double")
    assert [x[0] for x in r.apply(a).collect()] == [1.0, 1.0]
    assert [x[0] for x in r.apply(b).collect()] == [10.0, 10.0]


def test_unknown_step_raises(sample_df):
    with pytest.raises(ValueError):
        Recipe().record("explode", {}).apply(sample_df, fixed_order=False)


def test_run_recipe_end_to_end(spark, tmp_path):
    from tablewash.plans.recipe import run_recipe

    src = tmp_path / "in.csv"
    src.write_text("item,stock,shelf\nlamp,0,C3\n rope  ,55,A1\nlamp,0,C3\nlamp,0,C3\n", encoding="utf-8")
    r = (Recipe().record("read_file", {"file_path": str(src)}).record("replace_zeros", {"columns": ["stock"]})
         .record("remove_duplicates", {"remove": "yes"}).record("trim_whitespace", {}))
    out, report = run_recipe(spark, r, sink={"kind": "parquet", "path": str(tmp_path / "out")},
                             report_path=str(tmp_path / "rep"), report_format="json", generated_at="t")
    assert sorted((x["item"], x["stock"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [("lamp", None), ("rope", 55)]
    assert json.loads((tmp_path / "rep.json").read_text())["summary"]["rows_removed"] == 2
    with pytest.raises(ValueError):
        run_recipe(spark, Recipe())


def test_run_clean_then_replay(spark, tmp_path):
    from tablewash.plans.recipe import run_clean, run_recipe

    src = tmp_path / "in.csv"
    src.write_text("reel,metres\n  north ,0\nsouth,90\nsouth,90\n", encoding="utf-8")
    out, recipe, report = run_clean(
        spark, str(src), sink={"kind": "csv", "path": str(tmp_path / "out.csv"), "single_file": True},
        recipe_path=str(tmp_path / "r.json"), report_path=str(tmp_path / "rep"), generated_at="t",
        zeros=["metres"], missing=("fill", "mean"), remove_duplicates=True, case="uppercase",
    )
    assert sorted(tuple(r) for r in out.collect()) == [("NORTH", 90.0), ("SOUTH", 90.0)]
    assert recipe.get("read_file") == {"file_path": str(src)}
    replayed, _ = run_recipe(spark, Recipe.load(str(tmp_path / "r.json")), generated_at="t")
    assert sorted(tuple(r) for r in replayed.collect()) == [("NORTH", 90.0), ("SOUTH", 90.0)]
    assert (tmp_path / "rep.txt").read_text(encoding="utf-8").startswith("=== CLEANING REPORT ===")
