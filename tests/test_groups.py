"""Queries whose groups can be large hold no group in one row."""

import duckdb
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["graph_children", "graph_parents", "graph_inverted", "navigate_host_groups"])
def test_no_group_in_one_row(spark, name):
    df = driver.queries()[name](spark, DATA)
    assert "collect_" not in df._jdf.queryExecution().toString()
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    sql = con.execute(driver.oracle_sql()[name])
    order = [c[0] for c in sql.description]
    assert sorted(map(tuple, df.select(*order).collect())) == sorted(sql.fetchall())
