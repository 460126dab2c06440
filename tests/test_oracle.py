"""Every query with SQL against DuckDB on the smallest tables, values and names."""

import os

import duckdb
import pytest

from folioscope.oracle import SQL
import folioscope.page_queries  # noqa: F401
from folioscope.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table[n].to_pylist() for n in names), strict=True)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
