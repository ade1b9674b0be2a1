"""One row per key: the first or the last in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowrinse.functions.text import col, match_key, strip
from rowrinse.operators.ordering import ORDER, data_columns, with_order
from rowrinse.operators.roles import dedupe_keys

_RANK = "__rank"


def dedupe(
    df: DataFrame,
    mode: str = "unique_person",
    columns: Sequence[str] = (),
    keep: str = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Drop repeats by a mode's key columns; text keys compare trimmed and lower-cased."""
    keys = dedupe_keys(data_columns(df), mode, columns)
    if keys is None:
        return dedupe_rows(df, keep)
    types = {f.name: f.dataType for f in df.schema.fields}
    return keep_one(df, [match_key(col(c), types[c]) for c in keys], keep, order_by)


def dedupe_rows(df: DataFrame, keep: str = "first") -> DataFrame:
    """Drop exact repeats of whole rows.

    Repeats are alike in every column, so without an order a hash aggregate
    that combines before the shuffle is enough. With a carried ``ORDER`` the
    first or last row of each is picked as for any key, by a hash of the row.
    """
    if ORDER not in df.columns:
        return df.distinct()
    return keep_one(df, [col(c) for c in data_columns(df)], keep)


def dedupe_rows_normalized(df: DataFrame, keep: str = "first", order_by: Sequence[str] | None = None) -> DataFrame:
    """Drop rows that are alike in every column once trimmed and lower-cased; null and blank are alike."""
    keys = [F.lower(strip(F.coalesce(col(c).cast("string"), F.lit("")))) for c in data_columns(df)]
    return keep_one(df, keys, keep, order_by)


def keep_one(df: DataFrame, keys: Sequence[Column], keep: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first or last row of each key.

    The rank-one filter is pushed below the shuffle by the planner, so a task
    passes on one row per key and a key that many rows share stays small. The
    hash leads the sort: rows compare by one long, by the text only on a tie.
    """
    had_order = ORDER in df.columns
    ordered = with_order(df, order_by)
    order = F.col(ORDER).desc() if keep == "last" else F.col(ORDER).asc()
    window = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(order)
    out = ordered.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)
    return out if had_order else out.drop(ORDER)
