"""What the optimiser makes of the queries: pruning, pushdown, no per-row Python, no single task."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from holdfast.operators import metrics, ordered, split
from holdfast.plans.queries import engineered, final_scores
from holdfast.schema import ID
from holdfast.sources.subscriber import subscriber_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_branches_are_not_read(spark, folder):
    text = plan(subscriber_table(spark, folder).select(ID, "churn", "eqpdays", "months"))
    assert "l_partkey" not in text and "event_type" not in text
    whole = plan(subscriber_table(spark, folder))
    assert "l_partkey" in whole and "event_type" in whole


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = subscriber_table(spark, folder)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,error\)", text)
    assert "p_name" not in plan(subscriber_table(spark, folder))


def test_features_and_scores_add_no_shuffle(spark, folder):
    before = plan(subscriber_table(spark, folder)).count("Exchange hashpartitioning")
    assert plan(engineered(spark, folder)).count("Exchange hashpartitioning") <= before
    assert plan(final_scores(spark, folder)).count("Exchange hashpartitioning") <= before


@pytest.mark.parametrize("key", ["join_one_to_one", "engineered_features", "capture_lift_curve", "f1_threshold",
                                 "stratified_split", "ordinal_encode", "segment_fairness", "retention_actions"])
def test_no_python_workers_and_no_products(spark, folder, key):
    text = plan(entry.queries()[key](spark, folder))
    for banned in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct"):
        assert banned not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_row_level_windows_are_partitioned(spark):
    df = spark.range(1000).select(F.col("id").alias(ID), F.rand(1).alias("p"), F.lit("m").alias("model"),
                                  (F.col("id") % 2).cast("int").alias("churn"))
    for query in (ordered.global_rank(df, [F.desc("p"), F.asc(ID)]), metrics.cumulative(df)):
        windows = re.findall(r"windowspecdefinition\(([^)]*)", plan(query))
        assert windows and all("_slot" in w for w in windows)


def test_split_does_not_shuffle_the_rows(spark):
    df = spark.range(1000).select(F.col("id").alias(ID), (F.col("id") % 2).cast("int").alias("churn"))
    text = plan(split.stratified_split(df))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
