"""Row filters: blank rows, rule chains, search and category choice."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.labels import BLANK_LABEL
from rowrinse.functions.text import blank, col, is_number, is_text, parse_number
from rowrinse.operators.ordering import data_columns


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def _any(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def _all(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, conditions)


def drop_rows(df: DataFrame, when: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows that are blank in ``any`` or in ``all`` of the columns (default: every column)."""
    types = _types(df)
    names = [c for c in (columns if columns is not None else data_columns(df)) if c in types]
    if not names:
        return df
    blanks = [blank(col(c), types[c]) for c in names]
    return df.filter(~(_all(blanks) if when == "all" else _any(blanks)))


def as_number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}
_TEXT: dict[str, Callable[[Column, str], Column]] = {
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
}


def _compare_integers(c: Column, op: str, val: Any) -> Column:
    """Compare without leaving the integers: exact for every value, and pushed down to the scan."""
    try:
        number = Decimal(str(val).strip())
    except InvalidOperation:
        number = Decimal(as_number(val))
    top, bottom = number.is_nan() or number >= 2**63, not number.is_nan() and number < -(2**63)
    if top or bottom:
        always = op == "!=" or op in (("<", "<=") if top else (">", ">="))
        return c.isNotNull() if always else F.lit(False)
    floor = math.floor(number)
    if floor == number:
        return _COMPARE[op](c, F.lit(floor))
    if op in ("=", "!="):
        return c.isNotNull() if op == "!=" else F.lit(False)
    return c > F.lit(floor) if op in (">", ">=") else c <= F.lit(floor)


def rule_condition(df: DataFrame, column: str | None, op: str | None, val: Any = None) -> Column | None:
    """One rule as a condition, or None where the rule does not apply."""
    types = _types(df)
    if not column or not op or column not in data_columns(df):
        return None
    c, dtype = col(column), types[column]
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op in _TEXT:
        return _TEXT[op](c.cast("string"), str(val))
    if op not in _COMPARE:
        return None
    if op in ("=", "!=") and not is_number(dtype):
        return _COMPARE[op](c.cast("string"), F.lit(str(val)))
    number = as_number(val)
    if number is None:
        return None
    if isinstance(dtype, T.IntegralType):
        return _compare_integers(c, op, val)
    left = c if is_number(dtype) else parse_number(c) if is_text(dtype) else c.try_cast("double")
    return _COMPARE[op](left, F.lit(number))


def apply_rules(df: DataFrame, rules: Sequence[Mapping[str, Any]] | None, names: Mapping[str, str] | None = None) -> DataFrame:
    """Keep rows that meet every rule; ``names`` maps former to present column names."""
    for rule in rules or ():
        column = rule.get("column")
        if column not in df.columns:
            column = (names or {}).get(column, column)
        condition = rule_condition(df, column, rule.get("op"), rule.get("val"))
        if condition is not None:
            df = df.filter(condition)
    return df


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any cell, whatever the case."""
    wanted = text.lower()
    cells = [F.lower(col(c).cast("string")) for c in data_columns(df)]
    return df.filter(_any([c.contains(wanted) for c in cells]))


def choose_categories(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows of the chosen categories; an empty text or the blank label also admits blanks."""
    if not values:
        return df
    text = col(column).cast("string")
    chosen = text.isin(*dict.fromkeys(values))
    if "" in values or BLANK_LABEL in values:
        chosen = chosen | blank(text, df.select(text).schema[0].dataType)
    return df.filter(chosen)
