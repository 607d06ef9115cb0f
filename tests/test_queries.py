import pytest
from check_queries import open_tables, rows_of

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    frame = QUERIES[name](spark, FOLDER)
    got = rows_of(frame.columns, frame.collect())
    assert got
    if name in CHECKS:
        result = tables.execute(CHECKS[name])
        columns = [part[0] for part in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert got == rows_of(columns, result.fetchall())
