import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bizmetrics.session import configure, local_session  # noqa: E402

AS_OF = dt.date(2024, 5, 15)


@pytest.fixture(scope="session")
def spark():
    session = configure(local_session(8, "4g"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # plans are checked as text, in full
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    session.conf.set("spark.sql.debug.maxToStringFields", "1000")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Run a SQL-text function over a list of cells."""

    def run(function, cells, dtype="string"):
        rows = [(i, c) for i, c in enumerate(cells)]
        df = spark.createDataFrame(rows, f"i int, c {dtype}")
        out = df.selectExpr("i", f"{function('c')} AS r").orderBy("i").collect()
        return [r["r"] for r in out]

    return run
