"""Every query against its SQL."""

import pytest

from tidemark import catalog

from .compare import connect, differences

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    assert differences(df, con, ORACLE[name]) == ""


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(ORACLE)
