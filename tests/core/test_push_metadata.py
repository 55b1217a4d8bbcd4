import os

import pytest

from cubeloom.operators import metadata
from cubeloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_push_keeps_the_values_of_all_ancestors(spark):
    ids = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "a string, b int")
    meta = [(None, None, "k", ["all"]), ("x", None, "k", ["x"]), ("x", 1, "k", ["n", "all"]), ("y", None, "other", ["o"])]
    got = metadata.push(ids, spark.createDataFrame(meta, "a string, b int, key string, vals array<string>")).collect()
    want = {("x", 1, "k"): ["all", "n", "x"], ("x", 2, "k"): ["all", "x"], ("y", 1, "k"): ["all"], ("y", 1, "other"): ["o"]}
    assert {tuple(r)[:3]: r.vals for r in got} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["push_metadata", "resolve_metadata"])
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    assert got == sorted(con.sql(ORACLE_SQL[name]).fetchall()) and got
