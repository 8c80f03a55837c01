"""Every query that states itself in SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillmark.plans.registry import ORACLE_SQL, QUERIES
from quillmark.plans import catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    assert got == sorted((tuple(plain(row[theirs.index(c)]) for c in columns) for row in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
