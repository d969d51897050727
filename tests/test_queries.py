"""Every registered query against its SQL, or at least for rows and columns."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import table


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(data, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_lazy_and_has_a_schema(spark):
    assert {"model", "dataset", "rank"} <= set(entry.entry(spark).columns)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert mine[0] == want[0]
    assert mine[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0
