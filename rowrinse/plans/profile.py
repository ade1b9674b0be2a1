"""The profile of a table, and previews of it."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowrinse.functions.labels import report_cell, safe_cell, size_text
from rowrinse.functions.text import col
from rowrinse.operators.ordering import ORDER, first_rows, head_rows, with_order
from rowrinse.operators.summary import (
    before_after,
    column_statistics,
    duplicate_rows,
    sample_values,
    source_size,
    table_shape,
)
from rowrinse.options import CleaningOptions
from rowrinse.plans.clean import clean

# Rows in a preview unless the caller says otherwise.
PREVIEW_ROWS = 100


@dataclasses.dataclass(frozen=True)
class Profile:
    table: DataFrame
    columns: DataFrame
    preview: DataFrame
    size: DataFrame


def profile(df: DataFrame, order_by: Sequence[str] | None = None, exact: bool = True) -> Profile:
    """Table counts, one row per column, the first rows, and the size of the files."""
    ordered = with_order(df, order_by)
    stats = column_statistics(df, exact)
    samples = sample_values(ordered)
    columns = stats.join(samples.drop("column"), "position", "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<string>"))
    )
    table = table_shape(df).withColumn("duplicate_rows", duplicate_rows(df).scalar())
    return Profile(table, columns, preview(ordered).drop(ORDER), size_label(source_size(df)))


def preview(
    df: DataFrame,
    n: int = PREVIEW_ROWS,
    sort_by: Sequence[str] = (),
    descending: Sequence[bool] | None = None,
) -> DataFrame:
    """The first rows with cells that JSON can carry."""
    top = head_rows(df, n, sort_by, descending)
    return top.select(
        *[col(f.name) if f.name == ORDER else safe_cell(col(f.name), f.dataType).alias(f.name) for f in top.schema.fields]
    )


def clean_and_preview(
    df: DataFrame,
    options: CleaningOptions,
    order_by: Sequence[str] | None = None,
    match_list: DataFrame | None = None,
    n: int = PREVIEW_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The preview of a cleaned table, and the change in rows and columns."""
    cleaned = clean(df, options, order_by, match_list)
    shown = cleaned.limit(n)
    shown = shown.select(*[safe_cell(col(f.name), f.dataType).alias(f.name) for f in shown.schema.fields])
    return shown, before_after(df, cleaned)


def report_extract(
    df: DataFrame, max_rows: int | None = None, order_by: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All or the first rows as text for a report, and one row that says how many of the table they are."""
    ordered = with_order(df, order_by)
    top = ordered.orderBy(ORDER) if max_rows is None else first_rows(ordered, max_rows)
    cells = top.select(
        *[report_cell(col(f.name), f.dataType).alias(f.name) for f in top.schema.fields if f.name != ORDER]
    )
    limit = F.col("total_rows") if max_rows is None else F.lit(max_rows).cast("bigint")
    shown = F.least(F.col("total_rows"), limit)
    meta = table_shape(df).withColumns({"shown_rows": shown, "truncated": F.col("total_rows") > shown})
    return cells, meta


def size_label(sizes: DataFrame) -> DataFrame:
    """Add a readable form of ``size_bytes``."""
    return sizes.withColumn("size", size_text(F.col("size_bytes")))
