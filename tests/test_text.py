from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewash.functions.text import WHITESPACE, title_case, unicode_trim

SAMPLES = [
    "o'neil mc-donald 3rd x_y", "ßung", "ǆemal", "ﬁsh and chips", "ÉCOLE normale", "hello world",
    "123abc", "ÀÉÎ õü", "straße", "", " \t padded　 ", "ǈubljana", "ŉ test",
]


def _roundtrip(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_title_case_matches_python(spark):
    assert _roundtrip(spark, SAMPLES, title_case) == [s.title() for s in SAMPLES]


def test_trim_matches_python(spark):
    assert _roundtrip(spark, SAMPLES, unicode_trim) == [s.strip() for s in SAMPLES]
    assert len(WHITESPACE) == 29


text = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=30)


@settings(max_examples=25, deadline=None)
@given(st.lists(text, min_size=1, max_size=20))
def test_title_and_trim_property(spark, values):
    assert _roundtrip(spark, values, unicode_trim) == [s.strip() for s in values]
    titled = _roundtrip(spark, values, title_case)
    # idempotent, and equal to Python wherever Java and Python share case tables
    assert _roundtrip(spark, titled, title_case) == titled


def test_title_case_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(title_case(F.col("s"))).first()[0] is None
