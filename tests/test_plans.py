"""The plans are the ones meant for large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from registry.fixtures import table
from rowrinse.operators import dedupe, match, rows
from rowrinse.operators.columns import rename_columns, select_columns
from rowrinse.operators.ordering import head_rows, with_order
from rowrinse.operators.summary import duplicate_rows

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    df = select_columns(table(spark, SF_DIR, "lineitem"), ["l_quantity", "l_returnflag"])
    df = rename_columns(df, {"l_quantity": "Quantity"})
    text = plan(rows.apply_rules(df, [{"column": "Quantity", "op": ">", "val": "40"}]))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


def test_integer_rules_reach_the_scan(spark):
    df = rows.apply_rules(table(spark, SF_DIR, "lineitem").select("l_orderkey"), [{"column": "l_orderkey", "op": "<=", "val": "100.5"}])
    assert "LessThanOrEqual(l_orderkey,100)" in plan(df)


def test_repeats_are_cut_before_the_shuffle(spark):
    text = plan(dedupe.dedupe(table(spark, SF_DIR, "documents"), "custom", ["text"], order_by=["doc_id"]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert text.count("Exchange") == 1


def test_whole_rows_combine_before_the_shuffle(spark):
    text = plan(dedupe.dedupe_rows(table(spark, SF_DIR, "orders").drop("o_orderkey")))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_whole_rows_in_order_need_no_sorted_aggregate(spark):
    df = with_order(table(spark, SF_DIR, "orders").drop("o_orderdate"), ["o_orderkey"])
    text = plan(dedupe.dedupe_rows(df))
    assert "SortAggregate" not in text and "WindowGroupLimit" in text and text.count("Exchange") == 1


def test_repeated_rows_are_counted_by_digests(spark):
    text = plan(duplicate_rows(table(spark, SF_DIR, "orders")))
    assert "SortAggregate" not in text
    first = text[text.index("Exchange hashpartitioning") :].splitlines()[0]
    assert "o_clerk" not in first and "o_orderkey" not in first


def test_key_lists(spark):
    df = table(spark, SF_DIR, "orders").withColumn("k", F.col("o_custkey").cast("string"))
    short = plan(match.match_keys(df, "k", ["1", "2"]))
    assert "Join" not in short and "Exchange" not in short
    long = plan(match.match_keys(df, "k", [str(i) for i in range(5000)]))
    assert "BroadcastHashJoin" in long and "LeftSemi" in long
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(match.match_keys(df, "k", [str(i) for i in range(5000)]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gram_join_is_an_equi_join(spark):
    df = table(spark, SF_DIR, "documents")
    keys = df.select(F.col("lang").alias("__key")).distinct()
    text = plan(match.contains_by_grams(df, F.col("text"), keys, True))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_previews_are_top_k(spark):
    text = plan(head_rows(table(spark, SF_DIR, "orders"), 100, ["o_totalprice"], [True]))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_no_python_and_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for word in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text
