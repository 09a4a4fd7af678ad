"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from ladderwork.plans import queries

TABLES = "/root/testdata/sf0.001"
#: SQL holds for the tables given; without SQL other tests check the operator.
COMPARED = sorted(queries.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{TABLES}/{name}'")
    return con


def comparable(value, kind):
    if value is None or value != value:
        return ""
    return repr(round(float(value), 9) + 0.0) if kind in ("double", "float") else str(value)


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, TABLES)
    columns, kinds = sorted(got.columns), dict(got.dtypes)
    rows = sorted([comparable(r[c], kinds[c]) for c in columns] for r in got.collect())
    answer = duck.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    wanted = sorted([comparable(r[names.index(c)], kinds[c]) for c in columns] for r in answer.fetchall())
    assert rows == wanted


def test_each_query_without_sql_gives_rows(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)):
        assert queries.QUERIES[name](spark, TABLES).count() > 0
