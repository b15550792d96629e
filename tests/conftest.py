import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wayledger.operators.clean import clean_bookings
from wayledger.session import local_session
from wayledger.sources.bookings import RAW_COLUMNS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


DEFAULTS = dict.fromkeys(RAW_COLUMNS, None) | {
    "order_date": "2024-03-05", "order_id": "A1", "booking_status": "completed", "bnb_id": "B1",
    "bnb_name": "測試商品", "bnb_type": "eSIM", "nights": "1", "twd_amount": "100",
}


@pytest.fixture(scope="session")
def raw(spark):
    """Raw bookings from partial rows; unnamed columns take defaults."""
    def build(*rows):
        schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
        full = [tuple((DEFAULTS | row)[c] for c in RAW_COLUMNS) for row in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def clean(raw):
    return lambda *rows: clean_bookings(raw(*rows))
