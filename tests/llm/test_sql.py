"""Every query of the subpackage that SQL can state, against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import TABLES

from tallybird.llm.oracle import ORACLE_SQL
from tallybird.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    return connection


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, data_dir, name):
    df, result = QUERIES[name](spark, data_dir), duck.execute(ORACLE_SQL[name])
    theirs = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(theirs)
    columns = sorted(theirs)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    order = [theirs.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert len(ours) == len(expected)
    assert all(same(a, b) for x, y in zip(ours, expected) for a, b in zip(x, y))
