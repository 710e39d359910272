"""Every registered query that has SQL gives the rows of the SQL over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_the_sql(spark, duck, name):
    out = entry.queries()[name](spark, SF).toArrow()
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(out.column_names)
    assert columns == sorted(want.columns)
    got = sorted(map(repr, zip(*(out.column(c).to_pylist() for c in columns))))
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
