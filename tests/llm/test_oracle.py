"""Queries against their SQL."""

import pytest

from tests.compare import connect, differences
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    assert differences(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name]) == ""
