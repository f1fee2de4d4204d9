"""Every registered query against its SQL, over the whole tables."""

import os

import pytest

import oracle
from textforge.workloads import catalog

FOLDER = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, connection, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        assert oracle.compare(df, connection, catalog.ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 3
