"""Every query with SQL agrees with DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from muster.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def shown(frame):
    rows = frame[sorted(frame.columns)].astype(object).values.tolist()
    return sorted(repr([None if v is None or v != v else v for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    assert shown(QUERIES[name](spark, SF).toPandas()) == shown(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_row_is_lost(spark):
    total = QUERIES["mode1_stats"](spark, SF).first().total_rows
    assert QUERIES["mode1_records"](spark, SF).count() + QUERIES["mode1_issues"](spark, SF).count() == total
    assert QUERIES["mode2_records"](spark, SF).count() + QUERIES["mode2_issues"](spark, SF).count() == total
