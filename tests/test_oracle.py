import os

import pytest

import __spark_entry__ as entry
from oracle_check import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    result = entry.queries()[name](spark, SF_DIR)
    if name in entry.oracle_sql():
        assert differences(result, con, entry.oracle_sql()[name]) == []
    else:
        assert result.count() > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    result = entry.entry(spark)
    assert result.columns == entry.entry(spark).columns and result.count() > 0
