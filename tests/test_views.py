"""The views Spark reads in one scan hold the rows of their SQL text, and run as compiled code."""

from __future__ import annotations

import datetime

import pytest

from postern import session
from postern.plans import views


@pytest.fixture()
def tables(spark, tmp_path):
    day = datetime.date
    orders = [(k, k % 7 + 1, day(1995 + k % 3, 1, 1)) for k in range(1, 400)] + [(None, 1, day(1996, 1, 1)), (5, 2, None), (5, None, day(1996, 1, 1))]
    customers = [(c, c % 3) for c in range(1, 8)] + [(1, 1), (None, 2)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["lines", "tls_events"])
def test_one_scan_holds_the_rows_of_the_text_and_is_compiled(spark, tables, name):
    got = views.view(spark, tables, name)
    want = spark.sql(views.text(name).replace("FROM sess", "FROM {sess}"), sess=views.view(spark, tables, "sess"))
    assert got.columns == want.columns and got.count() > 400
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_session_built_elsewhere_gets_the_method_limit_unless_it_names_one(spark, tables):
    key = "spark.sql.codegen.hugeMethodLimit"
    try:
        for given, kept in (("65535", session.SETTINGS[key]), ("20000", "20000")):
            spark.conf.set(key, given)
            views.load(spark, tables, "orders")
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, session.SETTINGS[key])
