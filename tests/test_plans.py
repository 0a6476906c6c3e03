"""What the physical plans must and must not contain."""

import pytest
from helpers import physical
from pyspark.sql import functions as F

from millrace.operators import matrix
from millrace.operators.aggregates import word_count
from millrace.operators.joins import inner_join, join_count
from millrace.operators.ordering import head, top_groups
from millrace.operators.projection import filter_date, filter_eq
from millrace.operators.search import search_count
from millrace.plans import all_oracles, all_queries
from millrace.plans.relational import parquet_date_group
from millrace.sources.catalog import TABLES, table

# Queries that train or that run their streams before they return a plan.
EAGER = {"gbt_auc", "automl_leaderboard", "automl_regression", "mlp_predict"}


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = physical(parquet_date_group(spark, small))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
    plan = physical(filter_eq(table(spark, small, "customer"), "c_mktsegment", "BUILDING").select("c_custkey"))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_name" not in plan


def test_small_sides_are_broadcast_and_large_ones_shuffled(spark, small):
    nation, region = table(spark, small, "nation"), table(spark, small, "region")
    assert "BroadcastHashJoin" in physical(inner_join(nation, region, ("n_regionkey", "r_regionkey")))
    big = spark.range(10_000_000)
    plan = physical(inner_join(big, spark.range(10_000_000), "id"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_counting_a_join_shuffles_counts_once_per_side(spark):
    plan = physical(join_count(spark.range(10_000_000), spark.range(10_000_000), "id"))
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_count" in plan


def test_topk_keeps_k_rows_per_task(spark, small):
    orders = table(spark, small, "orders")
    assert "TakeOrderedAndProject" in physical(head(orders, 10, ["o_orderkey"]))
    assert "TakeOrderedAndProject" in physical(top_groups(orders, ["o_custkey"], 3))


def test_slice_moves_below_the_shuffle(spark):
    cells = spark.range(1000).select("id", (F.col("id") % 7).alias("j"), F.lit(1.0).alias("v")).withColumnRenamed("id", "i")
    plan = physical(matrix.slice2d(matrix.add_transpose(cells), 2, 3))
    assert plan.index("Exchange") < plan.index("Filter")
    fused = physical(matrix.transpose_add_row_mean(cells, 2, 3, 4))
    assert fused.count("Exchange") == 1 and "partial_sum" in fused


def test_text_work_stays_in_the_jvm(spark, small):
    documents = table(spark, small, "documents")
    for df in (word_count(documents, "text"), search_count(documents, ["text", "lang"], "the")):
        plan = physical(df)
        assert "Python" not in plan and "Pandas" not in plan


def test_a_date_in_a_timestamp_column_is_not_cast(spark, small):
    plan = physical(filter_date(table(spark, small, "lineitem"), "l_shipdate", "1997-01-15"))
    assert "cast(l_shipdate" not in plan


@pytest.mark.parametrize("name", sorted(set(all_queries()) - EAGER))
def test_no_query_multiplies_its_inputs(spark, small, name):
    plan = physical(all_queries()[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_registry_is_consistent():
    assert set(all_oracles()) <= set(all_queries())
    assert len(TABLES) == 14
