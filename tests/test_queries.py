"""Every registered query against its SQL twin on the smallest test folder."""

import pytest

import __spark_entry__ as contract
from workload import catalog
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
#: Request ids repeat from 4 000 events on, so the smallest data has no collision.
MAY_BE_EMPTY = {"request_collisions"}
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) in ((None, "EMPTY") if name in MAY_BE_EMPTY else (None,))
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0
