import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from barloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "tests", 4)


@pytest.fixture
def series(spark):
    """One code's values in date order, evaluated under a column function."""

    def run(fn, **cols):
        names = list(cols)
        n = len(cols[names[0]])
        rows = [("A", f"202401{i + 1:02d}", *[cols[c][i] for c in names]) for i in range(n)]
        schema = "ts_code string, trade_date string, " + ", ".join(f"{c} double" for c in names)
        df = spark.createDataFrame(rows, schema)
        return [r.v for r in df.select("trade_date", fn().alias("v")).orderBy("trade_date").collect()]

    return run
