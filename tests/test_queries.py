"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from comparing import difference, oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def connection():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, connection, name):
    df = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert difference(df, connection, sql) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["period", "capacity", "outage", "percentOutage", "offline_share_percent", "reason"]
    assert df.count() == 30
