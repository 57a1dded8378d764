import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, _rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "paired_comparisons", "vote_fraction_summary", "flattened_metadata",
    "difficulty_decile_summary", "residual_gram", "household_sample"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert _rows(got) == _rows(con.sql(entry.oracle_sql()[name]).df())
