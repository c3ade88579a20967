"""Every query that has SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from lattica.plans import function_queries, operator_queries

DATA = Path("/root/testdata/sf0.001")
QUERIES = operator_queries.QUERIES | function_queries.queries()
ORACLE = operator_queries.ORACLE | function_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bytearray | bytes):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLE:
        assert rows
        return
    answer = duck.execute(ORACLE[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in places) for r in answer.fetchall()), key=repr)
