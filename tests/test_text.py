from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions import labels, text


def one(spark, expression, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(expression(F.col("c")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "given,expected",
    [
        ("  a b ", "a b"),
        ("\t\n a  ", "a"),
        ("　\u0085x ", "x"),
        ("", ""),
        (" \t ", ""),
        (None, None),
        ("​z", "​z"),
    ],
)
def test_strip(spark, given, expected):
    assert one(spark, text.strip, given) == expected


@pytest.mark.parametrize("given,expected", [(None, True), ("", True), (" \t 　", True), (" x ", False), ("​", False)])
def test_blank(spark, given, expected):
    assert one(spark, lambda c: text.blank(c, T.StringType()), given) is expected


def test_collapse(spark):
    assert one(spark, text.collapse_spaces, "a \t b\n\n c") == "a b\n\n c"
    assert one(spark, text.collapse_whitespace, "a \t b\n\n c") == "a b c"


@pytest.mark.parametrize(
    "given,expected",
    [
        ("john's o-brien", "John'S O-Brien"),
        ("  HELLO wORLD", "  Hello World"),
        ("to infinity,and BEYOND!", "To Infinity,And Beyond!"),
        ("3rd élan", "3rd Élan"),
        ("a\x1f\x1f bC", "A\x1f\x1f Bc"),
        ("x\tyz\nab a1b2 _foo 9lives", "X\tYz\nAb A1b2 _Foo 9lives"),
        ("", ""),
        (None, None),
    ],
)
def test_title(spark, given, expected):
    assert one(spark, text.title_case, given) == expected


@pytest.mark.parametrize(
    "given,expected",
    [("(john) o'NEIL x-y", "(John) O'neil X-y"), ("élan VITAL", "éLan Vital"), ("", ""), (None, None)],
)
def test_title_tokens(spark, given, expected):
    assert one(spark, text.title_case_tokens, given) == expected


@pytest.mark.parametrize(
    "casing,expected",
    [
        ("UPPERCASE", "MIXED CASE"), ("all_caps", "MIXED CASE"), ("full_case", "MIXED CASE"), ("lower", "mixed case"),
        ("1st_letters", "Mixed Case"), ("capitalize_words", "Mixed Case"), ("1st_letter_only", "Mixed case"),
        ("sentencecase", "Mixed case"), ("no such", "mIXed cASE"), (None, "mIXed cASE"),
    ],
)
def test_casing_names(spark, casing, expected):
    assert one(spark, lambda c: text.with_casing(c, casing), "mIXed cASE") == expected


@pytest.mark.parametrize(
    "given,expected",
    [
        ("$1,250.00", 1250.0), ("₹45,000.50", 45000.5), (" $ 150.00 ", 150.0), ("€3 400", 3400.0), ("-£5%", -5.0),
        (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1.5f", None), ("2d", None), ("0x1p3", None), ("n/a", None), ("", None),
        (None, None), ("inf", math.inf), ("12 34", 1234.0), ("1.2.3", None),
    ],
)
def test_amount(spark, given, expected):
    assert one(spark, text.amount, given) == expected


@pytest.mark.parametrize(
    "given,expected",
    [
        ("India", "India"), (" a/b:c*d?[e]\\ ", "a_b_c_d__e__"), ("'q'", "q"), ("''", "Category"), (None, "Blank_Unspecified"),
        ("NaN", "Blank_Unspecified"), ("  ", "Blank_Unspecified"),
    ],
)
def test_sheet_title_base(spark, given, expected):
    assert one(spark, labels.sheet_title_base, given) == expected


def test_sheet_title_is_shortened_around_its_number(spark):
    long = "x" * 40
    assert one(spark, lambda c: labels.sheet_title(c, F.lit(0)), long) == "x" * 31
    assert one(spark, lambda c: labels.sheet_title(c, F.lit(12)), long) == "x" * 28 + "_12"


def test_file_names(spark):
    assert one(spark, labels.file_name_base, "a/b é-1") == "a_b _-1"
    assert one(spark, labels.file_name_base, None) == "Blank_Unspecified"
    assert len(one(spark, labels.file_name_base, "y" * 90)) == 50
    assert labels.safe_column_name("a b.c") == "a_b_c"


@pytest.mark.parametrize(
    "given,expected",
    [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**5, "3.0 PB"),
     (5000 * 1024**5, "5000.0 PB")],
)
def test_size(spark, given, expected):
    assert one(spark, labels.size_text, given, "bigint") == expected


def test_labels(spark):
    assert one(spark, labels.blank_label, " ") == "(Blank / Unspecified)"
    assert one(spark, labels.blank_label, " x ") == "x"
    assert one(spark, labels.blank_label, 5, "int") == "5"


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c`d"])
    assert df.select(text.col("a.b"), text.col("c`d")).first() == (1, 2)
