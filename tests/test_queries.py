import pytest

import __spark_entry__ as contract
from checks.compare import database, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert contract.own_queries().keys() == contract.oracle.statements().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("key", contract.own_queries())
def test_query_equals_its_sql(spark, con, key):
    assert differences(spark, con, SF, contract.own_queries()[key], contract.oracle.statements()[key]) == ""


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["query_id", "rank", "image_id", "votes"] and rows.count() > 0
