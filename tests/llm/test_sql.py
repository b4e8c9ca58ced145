"""Queries with SQL against DuckDB."""

import pytest
from oracle import rows

from rowlens.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    ours = queries.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
