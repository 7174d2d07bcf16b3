import pytest
from odd_texts import ODD

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", None, 1, "clash", 2.0) for i, t in enumerate(ODD)] + [(None, "no id", None, "s", 1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, score double")


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
