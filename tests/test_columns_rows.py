from __future__ import annotations

import pytest

from rowrinse.operators import columns, roles, rows
from rowrinse.plans.clean import clean_amounts


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(
        [(1, "a", None, " ", "x"), (2, "", None, "\t", None), (3, None, None, "", "y"), (None, " ", None, None, " ")],
        "n int, t string, e string, w string, u string",
    )


def test_select_keeps_order_and_ignores_unknown(dirty):
    assert columns.select_columns(dirty, ["u", "zz", "n", "u"]).columns == ["u", "n"]
    assert columns.select_columns(dirty, ["zz"]).columns == dirty.columns
    assert columns.invert_columns(dirty, ["u", "n"]).columns == ["t", "e", "w"]


def test_rename(dirty):
    assert columns.rename_columns(dirty, {"n": "N", "t": " ", "q": "z"}).columns == ["N", "t", "e", "w", "u"]


def test_blank_columns(dirty):
    assert columns.blank_columns(dirty) == ["e", "w"]
    assert columns.blank_columns(dirty, 75.0) == ["t", "e", "w"]
    assert columns.drop_blank_columns(dirty).columns == ["n", "t", "u"]
    assert columns.default_selection(dirty) == ["n", "t", "u"]


def test_nothing_is_dropped_when_nothing_would_remain(dirty):
    only = dirty.select("e", "w")
    assert columns.drop_blank_columns(only).columns == ["e", "w"]
    assert columns.drop_columns_with_blanks(dirty).columns == dirty.columns
    assert columns.blank_columns(dirty.limit(0)) == []
    assert columns.drop_columns_with_blanks(dirty.limit(0)).columns == dirty.columns


def test_drop_rows(dirty, values):
    part = dirty.select("n", "t", "u")
    assert values(rows.drop_rows(part, "any"), "n") == [(1,)]
    assert values(rows.drop_rows(part, "all"), "n") == [(1,), (2,), (3,)]
    assert values(rows.drop_rows(part, "any", ["u", "zz"]), "n") == [(1,), (3,)]
    assert values(rows.drop_rows(part, "all", ["t", "u"]), "n") == [(1,), (3,)]
    assert rows.drop_rows(part, "any", ["zz"]).count() == 4


def test_rules(dirty, values):
    def kept(*rule):
        return values(rows.apply_rules(dirty, [dict(zip(("column", "op", "val"), rule))]), "n")

    everything = values(dirty, "n")
    assert kept("n", "=", "2") == [(2,)]
    assert kept("n", "=", "two") == everything
    assert kept("n", "!=", 2) == [(1,), (3,)]
    assert kept("n", ">", "1.5") == [(2,), (3,)]
    assert kept("n", ">=", None) == everything
    assert kept("t", "is_null") == [(3,)]
    assert kept("t", "is_not_null") == [(1,), (2,), (None,)]
    assert kept("u", "contains", "x") == [(1,)]
    assert kept("u", "contains", ".") == []
    assert kept("u", "no such", "x") == everything
    assert kept("zz", "=", "x") == everything
    assert kept("u", "", "x") == everything


def test_rules_use_former_names(dirty, values):
    renamed = columns.rename_columns(dirty, {"n": "number"})
    out = rows.apply_rules(renamed, [{"column": "n", "op": "<", "val": 2}], {"n": "number"})
    assert values(out, "number") == [(1,)]


def test_number_rule_on_text(spark, values):
    df = spark.createDataFrame([("10",), ("9",), ("1.5f",), ("x",), (None,)], "t string")
    assert values(rows.apply_rules(df, [{"column": "t", "op": ">=", "val": "9"}])) == [("10",), ("9",)]


def test_search(spark, values):
    df = spark.createDataFrame([(1, "Apple", None), (12, "pear", "APPLY"), (3, None, None)], "n int, t string, u string")
    assert values(rows.search_rows(df, "appl"), "n") == [(1,), (12,)]
    assert values(rows.search_rows(df, "12"), "n") == [(12,)]
    assert values(rows.search_rows(df, "null"), "n") == []


def test_choose_categories(spark, values):
    df = spark.createDataFrame([(1, "a"), (2, " a"), (3, None), (4, " ")], "n int, c string")
    assert values(rows.choose_categories(df, "c", ["a"]), "n") == [(1,)]
    assert values(rows.choose_categories(df, "c", ["a", ""]), "n") == [(1,), (3,), (4,)]
    assert values(rows.choose_categories(df, "c", ["(Blank / Unspecified)"]), "n") == [(3,), (4,)]
    assert rows.choose_categories(df, "c", None).count() == 4


def test_amounts_auto(spark):
    data = [(f"${i}", f"note {i}", "7" if i == 3 else "x", str(i), "y") for i in range(30)]
    df = spark.createDataFrame(data, "amt string, note string, fee string, num string, city string")
    out = clean_amounts(df.withColumn("i", df.num.cast("int")), order_by=["i"])
    kinds = dict(out.dtypes)
    # one number among texts is no reason to lose the texts, whatever the column's name
    assert kinds == {"amt": "double", "note": "string", "fee": "string", "num": "double", "city": "string", "i": "int"}


NAMES = ["ID", "First Name", "last_name", "Full Name", "City", "Name"]


@pytest.mark.parametrize(
    "names,mode,chosen,expected",
    [
        (NAMES, "unique_person", (), ["First Name", "last_name"]),
        (["full_name", "first"], "unique_person", ("first",), ["full_name"]),
        (["first", "zip"], "unique_person", ("zip",), ["first"]),
        (["zip", "company name"], "unique_person", ("zip",), ["zip"]),
        (["zip", "company name"], "unique_person", (), ["company name"]),
        (["zip"], "unique_person", (), None),
        (NAMES, "unique_first_name", (), ["First Name"]),
        (["my first name", "surname"], "unique_first_name", (), ["my first name"]),
        (["zip", "surname"], "unique_first_name", (), ["surname"]),
        (["zip"], "unique_first_name", (), None),
        (NAMES, "unique_full_name", (), ["Full Name"]),
        (["Name", "nickname"], "unique_full_name", (), ["Name"]),
        (["a_name", "nickname"], "unique_full_name", (), ["a_name", "nickname"]),
        (NAMES, "custom", ("City", "zz"), ["City"]),
        (NAMES, "custom", (), ["First Name", "last_name"]),
        (["Name", "x"], "custom", (), ["Name"]),
        (NAMES, "all_columns", ("City",), None),
    ],
)
def test_dedupe_keys(names, mode, chosen, expected):
    assert roles.dedupe_keys(names, mode, chosen) == expected


def test_roles():
    assert roles.category_column(["a", "State", "Nationality", "my_country"]) == "my_country"
    assert roles.category_column(["a", "country_x", "Location Country"]) == "Location Country"
    assert roles.category_column(["a", "Status", "City"]) == "City"
    assert roles.category_column(["a", "b"]) == "a"
    assert roles.category_kind("Region") == "Geographic"
    assert roles.category_kind("sector") == "Category"
    assert roles.category_kind("amount") is None
    assert roles.key_column(["name", "Phone", "id"]) == "Phone"
    assert roles.key_column(["x"]) == "x"
    assert roles.secondary_sort_column(["x", "Company", "Full Name"]) == "Company"
    assert roles.name_sort(["First Name", "x", "Last Name"], "First Name", True) == (["First Name", "Last Name"], [True, True])
    assert roles.name_sort(["x", "Last Name"], "x") == (["x"], [False])
    assert roles.dedupe_preset(["First Name", "x", "Name"], "people") == ["First Name", "Name"]
    assert roles.dedupe_preset(["first", "x"], "first_name") == ["first"]
    assert roles.dedupe_preset(["y", "x"], "people") == ["y"]
    assert roles.dedupe_preset(["y", "x"], "all") == []
