"""Every registered query with a check must equal it on the given tables."""

import pytest
from checks import connect, normalized
from conftest import data_folder

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(data_folder("sf0.001"))


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    got = QUERIES[key](spark, data_folder("sf0.001")).toPandas()
    if key not in CHECKS:
        assert len(got.columns) > 0
        return
    want = duck.execute(CHECKS[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalized(got) == normalized(want)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
