import pytest
from oracle import duck, spark_rows

from marlstone.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck(SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_quantity)" in text and "l_comment" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


@pytest.mark.parametrize("name,node", [("join_broadcast", "BroadcastHashJoin"), ("join_shuffle", "SortMergeJoin"), ("join_hash", "ShuffledHashJoin"), ("topk_cosine", "TakeOrderedAndProject")])
def test_strategy(spark, name, node):
    assert node in plan(QUERIES[name](spark, SF))
