"""Queries with SQL give the same rows as the SQL."""

import pytest
from conftest import rows_of

from lotweave.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, folder, duck, name):
    got, want = queries.QUERIES[name](spark, folder).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
