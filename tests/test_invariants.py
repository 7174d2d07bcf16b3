"""Invariants on random tables."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewash.operators import clean, profile
from tablewash.plans.recipe import Recipe, clean_table

TEXT = st.one_of(st.none(), st.text(alphabet=" \t abcXYZßéÉ'-1", max_size=8))
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), TEXT), min_size=0, max_size=15).map(
    lambda rs: rs + rs[: len(rs) // 3]
)


def frame(spark, rows):
    return spark.createDataFrame(rows, "a bigint, s string")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=15, deadline=None)
@given(ROWS)
def test_text_steps_idempotent(spark, rows):
    df = frame(spark, rows)
    t = clean.trim_text(df)
    assert values(clean.trim_text(t)) == values(t)
    for case in ("lowercase", "uppercase", "titlecase"):
        once = clean.standardize_case(t, case)
        assert values(clean.standardize_case(once, case)) == values(once)


@settings(max_examples=15, deadline=None)
@given(ROWS)
def test_rows_equal_distinct_plus_duplicates(spark, rows):
    df = frame(spark, rows)
    d = profile.duplicate_summary(df).first()
    assert d["n_rows"] == len(rows) == d["n_distinct"] + d["duplicates"]
    assert clean.remove_duplicates(df).count() == d["n_distinct"] == len(set(rows))


@settings(max_examples=15, deadline=None)
@given(ROWS, st.sampled_from([7, "x", 0.5]))
def test_nothing_missing_after_literal_fill(spark, rows, value):
    out = clean.fill_literal(frame(spark, rows), value)
    assert out.where(F.col("a").isNull() | F.col("s").isNull()).count() == 0


@settings(max_examples=10, deadline=None)
@given(ROWS)
def test_replay_after_save_load(spark, rows):
    df = frame(spark, rows)
    out, recipe = clean_table(df, zeros="all", missing=("fill", "mode"), remove_duplicates=True, case="titlecase")
    assert values(Recipe.loads(recipe.dumps()).apply(df)) == values(out)
