"""Display labels, file-safe names, byte sizes and safe preview cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.text import blank, strip

# Labels that readers of an export see.
BLANK_LABEL = "(Blank / Unspecified)"
BLANK_NAME = "Blank_Unspecified"
EMPTY_NAME = "Category"
TOTAL_LABEL = "TOTAL"
SUMMARY_SHEET = "Overview_Summary"
SUMMARY_FILE = "00_Overview_Summary"
NULL_WORDS = ("null", "none", "nan")
SHEET_TITLE_LIMIT = 31
FILE_NAME_LIMIT = 50
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def blank_label(c: Column) -> Column:
    """The value trimmed, or the blank label."""
    text = c.cast("string")
    return F.when(blank(text, T.StringType()), BLANK_LABEL).otherwise(strip(text))


def raw_category(c: Column) -> Column:
    """The value trimmed, or the name that stands for a blank in file names."""
    text = c.cast("string")
    return F.when(blank(text, T.StringType()), BLANK_NAME).otherwise(strip(text))


def sheet_title_base(c: Column) -> Column:
    """Text made legal as a sheet title, before shortening and numbering."""
    raw = strip(F.coalesce(c.cast("string"), F.lit("")))
    legal = strip(F.trim(F.regexp_replace(raw, r"[\\/*?:\[\]]", "_"), F.lit("'")))
    return (
        F.when((raw == "") | F.lower(raw).isin(*NULL_WORDS), BLANK_NAME)
        .when(legal == "", EMPTY_NAME)
        .otherwise(legal)
    )


def sheet_title(base: Column, number: Column) -> Column:
    """The title with its collision number (0 = none), within the length limit."""
    suffix = F.concat(F.lit("_"), number.cast("string"))
    return F.when(number == 0, F.left(base, F.lit(SHEET_TITLE_LIMIT))).otherwise(
        F.concat(F.left(base, F.lit(SHEET_TITLE_LIMIT) - F.length(suffix)), suffix)
    )


def file_name_base(c: Column) -> Column:
    """Text made safe as a file name, before numbering."""
    safe = F.left(strip(F.regexp_replace(raw_category(c), r"[^a-zA-Z0-9_\- ]", "_")), F.lit(FILE_NAME_LIMIT))
    return F.when(safe == "", EMPTY_NAME).otherwise(safe)


def file_name(base: Column, number: Column) -> Column:
    return F.when(number == 0, base).otherwise(F.concat(base, F.lit("_"), number.cast("string")))


def safe_column_name(name: str) -> str:
    """A column name as part of a path."""
    return re.sub(r"[^a-zA-Z0-9_]", "_", name)


def size_text(c: Column) -> Column:
    """A byte count with one decimal and its unit."""
    out = None
    for step, unit in enumerate(SIZE_UNITS):
        text = F.format_string(f"%.1f {unit}", F.bround(c.cast("double") / float(1024**step), 1))
        small = c < 1024 ** (step + 1)
        if out is None:
            out = F.when(small, text)
        elif unit != SIZE_UNITS[-1]:
            out = out.when(small, text)
        else:
            out = out.otherwise(text)
    return out


def finite(c: Column, dtype: T.DataType) -> Column:
    """NaN and infinities to null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)
    return c


def safe_cell(c: Column, dtype: T.DataType) -> Column:
    """A value that JSON can carry: ISO date text, finite floats, text for nested values."""
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        parts = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.when(parts.endswith(".000000"), whole).otherwise(parts)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, (T.DecimalType, T.BinaryType, T.DayTimeIntervalType)):
        return c.cast("string")
    return finite(c, dtype)


def report_cell(c: Column, dtype: T.DataType) -> Column:
    """A value as report text; what is missing or not finite shows as nothing."""
    text = F.to_json(c) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else finite(c, dtype).cast("string")
    return F.coalesce(text, F.lit(""))
