"""Every query with SQL against DuckDB at the smallest scale."""

import os

import pytest

from cubeloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(map(repr, con.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall()))
