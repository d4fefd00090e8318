"""The order across types, of all rows, without a window over all of them."""

import duckdb

from tarnlake.plans import queries

DIR = "/root/testdata/sf0.1"


def test_all_types_are_numbered(spark):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{DIR}/part.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["cross_type_order_all"]).fetchall())
    got = queries.QUERIES["cross_type_order_all"](spark, DIR)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 20_000
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
