import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from itemscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", spark__sql__shuffle__partitions=4,
                            spark__ui__enabled="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def to_rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def long_table(spark):
    """Builds (subject, item_id, y) rows from a dense matrix with NaN for missing cells."""
    def build(matrix, subject="s", item="i"):
        rows = [(f"{subject}{a:02d}", f"{item}{b:03d}", int(v))
                for a, row in enumerate(matrix) for b, v in enumerate(row) if v == v]
        return spark.createDataFrame(rows, "subject string, item_id string, y int")
    return build
