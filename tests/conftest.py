import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tablewash.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="tablewash-tests")
    yield s
    s.stop()


@pytest.fixture()
def sample_df(spark):
    """Consignments: zeros, repeated rows, padded text, a boolean."""
    return spark.createDataFrame(
        [
            ("Tin sheets ", 0, "Bay 9", 120.25, True),
            ("cork", 14, " Bay 2 ", 0.0, False),
            ("cork", 14, " Bay 2 ", 0.0, False),
            ("Glass wool", 3, "Bay 4", 77.0, True),
            ("Tin sheets ", 0, "Bay 9", 120.25, True),
            ("oak planks", 21, "Bay 2", 310.5, False),
        ],
        "goods string, pallets bigint, bay string, kilos double, sealed boolean",
    )


@pytest.fixture()
def df_with_missing(spark):
    """Soundings: one whole row, one whole column."""
    return spark.createDataFrame(
        [("K1", 4.5, None, "calm"), (None, 7.0, 31.2, "swell"), ("K3", None, 33.0, "calm"), ("K4", 9.25, 30.1, "fog")],
        "station string, depth double, salinity double, sea string",
    )
