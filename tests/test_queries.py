"""Every query with SQL must give what DuckDB gives."""

import pytest
from oracle import DATA, rows

from rowlens import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    ours = queries.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(queries.QUERIES) <= set(e.queries())


def test_field_similarity_of_all_tables(spark):
    found = {(r.table1, r.field1, r.table2, r.field2): r.score for r in queries.field_similarity_pairs(spark, DATA).collect()}
    assert len({(a, b) for a, _, b, _ in found}) == len(queries.TABLES) * (len(queries.TABLES) - 1) // 2
    assert found["documents", "doc_id", "labels", "doc_id"] == 1.0
