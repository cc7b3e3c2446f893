"""Every registered query equals its SQL on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as contract
from flowtide import lens

QUERIES = lens.load()

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    problem = oracle.compare(spark, db, *QUERIES[name], FOLDER)
    assert problem is None, problem
