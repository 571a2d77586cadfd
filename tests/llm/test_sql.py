"""The text queries that have SQL against DuckDB, on the smallest tables."""

import pytest

from tempora.llm import queries
from tests.compare import DATA, check


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert not check(spark, name, queries.queries()[name], queries.oracle_sql()[name], f"{DATA}/sf0.001")
