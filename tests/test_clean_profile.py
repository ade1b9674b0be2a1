from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from rowrinse import CleaningOptions, clean, clean_lite, profile
from rowrinse.operators import summary
from rowrinse.plans.profile import clean_and_preview, preview, report_extract, size_label


def golden_table(spark, rows):
    """200,000 ids appear twice in a million rows; names are padded and unique; two columns are blank."""
    i = F.col("id")
    return spark.range(rows).select(
        F.concat(F.lit("CUST-"), (i % 800_000).cast("string")).alias("Customer_ID"),
        F.concat(F.lit("  User_"), i.cast("string"), F.lit("   ")).alias("User_Name"),
        F.lit(None).cast("string").alias("Blank_Col_1"),
        F.concat(F.lit("$"), (i % 1000 * 1.5).cast("string")).alias("Transaction_Amt"),
        F.lit(None).cast("string").alias("Blank_Col_2"),
        F.when(i % 2 == 0, "Active").otherwise("Inactive").alias("Status"),
    )


def test_golden_extraction(spark):
    options = CleaningOptions(
        clean_numeric_symbols=True,
        numeric_target_columns=["Transaction_Amt"],
        bulk_match_column="Customer_ID",
        bulk_match_values=[f"CUST-{i}" for i in range(100, 5100)],
        selected_columns=["Customer_ID", "User_Name", "Transaction_Amt", "Status"],
        sort_columns=["Customer_ID"],
        sort_descending=[False],
    )
    df = golden_table(spark, 1_000_000)
    out = clean(df, options)
    assert out.columns == ["Customer_ID", "User_Name", "Transaction_Amt", "Status"]
    assert out.agg(F.count("*"), F.sum("Transaction_Amt")).first() == (10_000, 7_492_500.0)
    first = [tuple(r) for r in out.limit(3).collect()]
    assert first[:2] == [("CUST-100", "User_100", 150.0, "Active"), ("CUST-100", "User_800100", 150.0, "Active")]
    assert first[2] == ("CUST-1000", "User_1000", 0.0, "Active")


def test_golden_profile(spark):
    found = profile(golden_table(spark, 10_000))
    columns = {r["column"]: r for r in found.columns.collect()}
    assert [c for c in columns if columns[c]["is_blank"]] == ["Blank_Col_1", "Blank_Col_2"] or {
        c for c in columns if columns[c]["is_blank"]
    } == {"Blank_Col_1", "Blank_Col_2"}
    assert found.table.first() == (10_000, 6, 0)
    assert columns["User_Name"]["distinct_count"] == 10_000
    assert columns["User_Name"]["samples"][:2] == ["  User_0   ", "  User_1   "]
    assert columns["Blank_Col_1"]["distinct_count"] == 1 and columns["Blank_Col_1"]["samples"] == []
    assert found.preview.count() == 100


def test_step_order(spark, values):
    """Blank columns are judged before rows go; fills see the rows that are left; sort sees the fills."""
    data = [(1, "a", None, 10.0), (2, "b", "x", None), (3, None, None, 50.0), (4, "d", None, 30.0)]
    df = spark.createDataFrame(data, "n int, t string, only_b string, v double")
    options = CleaningOptions(
        remove_duplicates=False,
        drop_rows_with_null_in_cols=["t"],
        filter_rules=[{"column": "n", "op": "!=", "val": "0"}],
        fill_nulls_mode="mean",
        fill_nulls_columns=["v"],
        sort_columns=["v"],
        sort_descending=[True],
    )
    out = clean(df, options, ["n"])
    assert [tuple(r) for r in out.collect()] == [(4, "d", None, 30.0), (2, "b", "x", 20.0), (1, "a", None, 10.0)]


def test_only_the_strictest_row_rule_runs(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("b", "c")], "x string, y string")
    options = CleaningOptions(remove_duplicates=False, remove_all_blank_columns=False)
    assert clean(df, options).count() == 2
    assert clean(df, options.replace(drop_rows_with_null_in_cols=["y"])).count() == 1
    assert clean(df, options.replace(drop_rows_with_null_in_cols=["zz"])).count() == 3
    assert clean(df, options.replace(drop_row_if_any_null=True)).count() == 1
    lite = CleaningOptions(remove_duplicates=False, drop_rows_with_null_in_cols=["y"], drop_null_mode="all")
    assert clean_lite(df, lite).count() == 1


def test_strict_columns_take_priority(spark):
    df = spark.createDataFrame([("a", "b", 1), ("c", " ", 2)], "x string, y string, z int")
    assert clean(df, CleaningOptions(drop_col_if_any_null=True, blank_column_threshold_pct=10.0)).columns == ["x", "z"]


def test_former_names_everywhere(spark):
    df = spark.createDataFrame([(i, f" k{i % 3} ", f"${i}") for i in range(6)], "n int, key string, amt string")
    options = CleaningOptions(
        rename_columns={"key": "Key", "amt": "Amount"},
        numeric_target_columns=["amt"],
        clean_numeric_symbols=True,
        bulk_match_column="key",
        bulk_match_values=["k0", "k1"],
        dedupe_names_mode="custom",
        duplicate_columns=["key"],
        duplicate_keep="last",
        sort_columns=["amt"],
        sort_descending=[True],
    )
    assert [tuple(r) for r in clean(df, options, ["n"]).collect()] == [(4, "k1", 4.0), (3, "k0", 3.0)]


def test_order_column_need_not_be_selected(spark, values):
    df = spark.createDataFrame([(i, "same", i * 10) for i in range(5)], "n int, name string, v int")
    options = CleaningOptions(selected_columns=["name", "v"], duplicate_keep="last")
    assert values(clean(df, options, ["n"])) == [("same", 40)]


def test_stringify(spark):
    df = spark.createDataFrame([(1, " a ", 2.5)], "n int, t string, d double")
    options = CleaningOptions(stringify=True)
    assert tuple(clean(df, options).first()) == ("1", "a", "2.5")
    only = CleaningOptions(stringify=True, trim_whitespace=False, text_casing="upper", casing_target_columns=["n", "t"])
    assert dict(clean(df, only).dtypes) == {"n": "string", "t": "string", "d": "double"}


def test_options_record():
    options = CleaningOptions.from_dict({"trim_whitespace": False, "sort_columns": ["a"]})
    assert options.trim_whitespace is False and options.remove_duplicates is True
    with pytest.raises(TypeError):
        CleaningOptions.from_dict({"no_such": 1})


def test_lite_compares_whole_rows(spark, values):
    data = [(1, "A x", None), (2, "a  X", ""), (3, "b", "é y")]
    df = spark.createDataFrame(data, "n int, t string, u string")
    options = CleaningOptions(collapse_multiple_spaces=True, text_casing="titlecase", selected_columns=["t", "u"])
    assert values(clean_lite(df, options, ["n"])) == [("A X", None), ("B", "é Y")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "name string, v double")
    options = CleaningOptions(fill_nulls_mode="median", clean_numeric_symbols=True, sort_columns=["v"])
    assert clean(df, options).columns == ["name", "v"] and clean(df, options).count() == 0
    stats = [r.asDict() for r in summary.column_statistics(df).collect()]
    assert [(s["column"], s["blank_count"], s["distinct_count"], s["is_blank"]) for s in stats] == [
        ("name", 0, 0, False), ("v", 0, 0, False)]
    assert summary.duplicate_rows(df).first()[0] == 0
    assert summary.value_counts(df, "name").count() == 0


@pytest.mark.parametrize("how", ["branch", "unpivot", "approximate"])
def test_statistics_agree_however_they_are_made(spark, monkeypatch, how):
    data = [(1, " ", 0.0, [1]), (2, None, -0.0, None), (2, "a", float("nan"), [1]), (None, "a", float("nan"), [2])]
    df = spark.createDataFrame(data, "n int, t string, d double, l array<int>")
    if how == "unpivot":
        monkeypatch.setattr(summary, "BRANCH_COLUMNS", 0)
    stats = {r["column"]: r for r in summary.column_statistics(df, how != "approximate").collect()}
    got = {c: (r["blank_count"], r["blank_pct"], r["distinct_count"]) for c, r in stats.items()}
    assert got == {"n": (1, 25.0, 3), "t": (2, 50.0, 3), "d": (0, 0.0, 2), "l": (1, 25.0, 3)}


def test_duplicate_rows_count_every_member(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a"), (3, "b"), (3, "b")], "n int, t string")
    assert summary.duplicate_rows(df).first()[0] == 5


def test_value_counts(spark):
    df = spark.createDataFrame([("India",), ("India ",), (None,), (" ",), ("India",), ("b",)], "c string")
    assert [tuple(r) for r in summary.value_counts(df, "c").collect()] == [
        ("India", "India", 2), ("", "(Blank / Unspecified)", 1), ("", "(Blank / Unspecified)", 1), ("India", "India", 1), ("b", "b", 1)]
    assert summary.value_counts(df, "c", 1).count() == 1
    assert summary.value_counts(df, "zz").count() == 0
    assert summary.distinct_total(df, "c").first()[0] == 5
    assert summary.distinct_total(df, "zz").first()[0] == 0


def test_summary_total_is_not_a_null_category(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), ("TOTAL",)], "c string")
    rows = [tuple(r) for r in summary.category_summary(summary.category_counts(df, "c")).collect()]
    assert rows == [("a", 2, 0.5, False), ("(Blank / Unspecified)", 1, 0.25, False), ("TOTAL", 1, 0.25, False), ("TOTAL", 4, 1.0, True)]


def test_samples_beyond_the_head(spark, monkeypatch):
    """A column whose first values come late is searched on its own."""
    monkeypatch.setattr(summary, "HEAD_FACTOR", 1)
    df = spark.range(100).select("id", F.when(F.col("id") > 50, F.concat(F.lit("v"), F.col("id"))).alias("late"), F.lit(" ").alias("b"))
    got = {r["column"]: r["samples"] for r in summary.sample_values(df, order_by=["id"]).collect()}
    assert got == {"id": ["0", "1", "2", "3"], "late": ["v51", "v52", "v53", "v54"]}


def test_preview_cells(spark):
    row = (datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), float("nan"), [1], b"x")
    df = spark.createDataFrame([row], "d date, t timestamp_ntz, f double, a array<int>, b binary")
    assert tuple(preview(df).first()) == ("2024-01-02", "2024-01-02T03:04:05", None, "[1]", "x")
    assert preview(spark.range(900), 800).count() == 800


def test_clean_and_preview(spark):
    df = spark.createDataFrame([("a", None), ("a ", None), ("b", None)], "name string, e string")
    shown, change = clean_and_preview(df.withColumn("n", F.monotonically_increasing_id()), CleaningOptions(), ["n"])
    assert shown.count() == 2
    assert change.first().asDict() == {
        "rows_before": 3, "cols_before": 3, "rows_after": 2, "cols_after": 2, "removed_rows": 1, "removed_cols": 1,
        "row_change_pct": 33.3, "columns": ["name", "n"]}


def test_report(spark):
    df = spark.createDataFrame([(1, None, float("inf")), (2, "x", 1.0)], "n int, t string, d double")
    cells, meta = report_extract(df, 15_000, ["n"])
    assert [tuple(r) for r in cells.collect()] == [("1", "", ""), ("2", "x", "1.0")]
    assert meta.first() == (2, 3, 2, False)
    assert report_extract(spark.range(1500), 1000)[1].first() == (1500, 1, 1000, True)


def test_source_size(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).repartition(3).write.parquet(path)
    real = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    assert size_label(summary.source_size(spark.read.parquet(path))).first()["size_bytes"] == real


def test_wide_and_narrow_statistics_agree_on_every_type(spark, monkeypatch):
    # two instants of one local time, where the clock goes back
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(b"", 1729989000000000, "a"), (b"  ", 1729992600000000, None), (None, None, ""), (b"x", 1729989000000000, "a")]
    df = spark.createDataFrame(rows, "raw binary, micros bigint, name string").select(
        "raw", F.timestamp_micros("micros").alias("at"), "name",
        F.when(F.col("raw").isNotNull(), F.struct(F.timestamp_micros("micros").alias("at"), "name")).alias("nested"),
        F.array("name").alias("list"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        narrow = sorted(map(tuple, summary.column_statistics(df).collect()))
        monkeypatch.setattr(summary, "BRANCH_COLUMNS", 0)
        assert sorted(map(tuple, summary.column_statistics(df).collect())) == narrow
        assert [r[3] for r in narrow] == [1, 1, 2, 1, 0]
        assert [r[5] for r in narrow] == [4, 3, 3, 3, 3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_repeats_with_nulls_and_nested_values(spark):
    from rowrinse.operators.summary import duplicate_rows

    rows = [(None, "a", [1, None]), ("a", None, [1, None]), ("a", None, [None, 1]), ("a", None, [1, None]), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "x string, y string, l array<int>")
    assert duplicate_rows(df).first()[0] == 4
    assert duplicate_rows(df.limit(0)).first()[0] == 0
