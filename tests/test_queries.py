"""Registered queries of the engine against their SQL."""

import os

import duckdb
import pytest

from quillon import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def same(rows, names, others, other_names):
    assert sorted(names) == sorted(other_names)
    order, other = ([sorted(range(len(n)), key=n.__getitem__) for n in (names, other_names)])
    text = lambda rs, o: sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in o]) for r in rs)
    assert text(rows, order) == text(others, other)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df, expected = queries.QUERIES[name](spark, SF), tables.sql(queries.ORACLE_SQL[name])
    same(df.collect(), df.columns, expected.fetchall(), expected.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name,column,descending", [("order_by_asc", "C_ACCTBAL", False), ("order_by_desc", "C_ACCTBAL", True), ("order_after_join", "ORDERS.O_ORDERKEY", False)])
def test_order(spark, name, column, descending):
    values = [r[column] for r in queries.QUERIES[name](spark, SF).collect()]
    assert values == sorted(values, reverse=descending) and len(values) > 10


def test_join_real_texts_of_zero(spark, tmp_path):
    """Zeros of both signs, a balance of more decimals, and none."""
    balances = [-0.0, 0.0, 5.0, 12.5, -12.5, 7.251, 7.25, -0.001, 9999.99, None]
    rows = [(k, f"c{k}", k % 25, v, "BUILDING") for k, v in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as from '{tmp_path}/customer.parquet/*.parquet'")
    df, expected = queries.QUERIES["join_real_texts"](spark, str(tmp_path)), con.sql(queries.ORACLE_SQL["join_real_texts"])
    found = df.collect()
    same(found, df.columns, expected.fetchall(), expected.columns)
    assert sum(r["TEXTS.K"] == "0" for r in found) == 9


def test_entry(spark):
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() == 66
