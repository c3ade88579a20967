"""Operators that SQL can express give the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from lattica import llm


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, duck, data, name):
    got = llm.queries()[name](spark, data)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    answer = duck.execute(llm.oracle_sql()[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in places) for r in answer.fetchall()), key=repr)


def test_names():
    assert [n.split("_")[0] for n in sorted(llm.queries(), key=lambda n: int(n.split("_")[0][2:]))] == [f"op{i}" for i in range(1, 11)]
