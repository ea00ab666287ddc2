import pytest
from differential import compare

from stratum.operators import engine, relational

QUERIES = relational.queries() | engine.queries()
SQL = relational.oracle_sql() | engine.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_aggregate_is_partial_then_final(spark):
    plan = QUERIES["agg_group"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "partial_count" in plan and "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>" in plan
    assert "TakeOrderedAndProject" in QUERIES["topk_agg"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
