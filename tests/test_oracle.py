import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verification.oracle import ORACLES
from verification.registry import QUERIES
from verification.compare import differences, oracle_connection


@pytest.fixture(scope="module")
def connection():
    return oracle_connection("/root/testdata/sf0.001")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, connection, sf_dir, key):
    assert differences(spark, connection, key, sf_dir) == []


def test_entry(spark):
    assert entry(spark).count() > 4


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
