"""Writing a table by category: sorted, one folder per category, or one sheet per category."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowrinse.functions.labels import (
    FILE_NAME_LIMIT,
    SHEET_TITLE_LIMIT,
    SUMMARY_FILE,
    SUMMARY_SHEET,
    file_name,
    file_name_base,
    safe_column_name,
    sheet_title,
    sheet_title_base,
)
from rowrinse.functions.text import col
from rowrinse.operators.ordering import BLOCK, ORDER, SLOT, in_blocks, sort_keys, with_order
from rowrinse.operators.rows import choose_categories
from rowrinse.operators.summary import category_counts, category_summary, file_summary
from rowrinse.session import leaves_no_scratch, stage
from rowrinse.sinks.writers import SHEET_ROWS_MAX, in_index_order, rows_per_task, write_table

MODES = ("sorted_unified", "zip", "sheets")


def number_names(
    categories: DataFrame, limit: int, render: Callable[[Column, Column], Column], reserved: Sequence[str] = ()
) -> DataFrame:
    """Give every (category, base) a name that differs from all others whatever the case.

    In category order, each takes the first free one of its names with suffix
    none, 1, 2, ... Categories with the same base are numbered at once. A
    numbered name may still be another category's own; then the later of the
    two moves on, and those after it with its base, until no clash is left.
    """
    order = [F.col("category").isNull(), F.col("category")]
    same_base = Window.partitionBy("key").orderBy(*order)
    named = (
        categories.withColumn("key", F.lower(F.left("base", F.lit(limit))))
        .withColumn("rank", F.row_number().over(same_base) - 1)
        .withColumn("number", F.col("rank"))
    )
    same_name = Window.partitionBy(F.lower("name")).orderBy(*order)
    taken = F.lower("name").isin(*[r.lower() for r in reserved]) if reserved else F.lit(False)
    so_far = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        named = named.withColumn("name", render(F.col("base"), F.col("number")))
        # the reserved names count as held by an earlier category
        named = stage(named.withColumn("lost", (taken | (F.row_number().over(same_name) > 1)).cast("int")))
        if named.filter("lost = 1").isEmpty():
            return named.select("category", "base", "name")
        moved = F.col("rank") + F.max(F.col("number") + F.col("lost") - F.col("rank")).over(so_far)
        named = named.withColumn("number", moved).drop("lost", "name")


def sheet_titles(categories: DataFrame, reserved: Sequence[str] = (SUMMARY_SHEET,)) -> DataFrame:
    """Sheet titles of (category): legal, short enough and distinct."""
    based = categories.select("category", sheet_title_base(F.col("category")).alias("base"))
    return number_names(based, SHEET_TITLE_LIMIT, sheet_title, reserved)


def file_names(categories: DataFrame) -> DataFrame:
    """File names of (category): safe, short enough and distinct."""
    based = categories.select("category", file_name_base(F.col("category")).alias("base"))
    return number_names(based, FILE_NAME_LIMIT, file_name)


@leaves_no_scratch
def write_by_category(
    df: DataFrame,
    split_column: str,
    path: str,
    export_mode: str = "sheets",
    fmt: str = "csv",
    selected_categories: Sequence[str] | None = None,
    include_summary_sheet: bool = True,
    secondary_sort_column: str | None = None,
    secondary_sort_descending: bool = False,
    order_by: Sequence[str] | None = None,
    sheet_rows: int = SHEET_ROWS_MAX,
) -> dict:
    """Write ``df`` grouped by a column; returns what was written where.

    ``sorted_unified`` is one table in category order. ``zip`` and ``sheets``
    have one folder per category plus an overview; in ``sheets`` a category
    longer than a sheet goes on in further sheets, so no row is lost.
    """
    if split_column not in df.columns:
        raise ValueError(f"no category column {split_column!r}")
    if export_mode not in MODES:
        raise ValueError(f"unknown export mode {export_mode!r}; modes: {', '.join(MODES)}")
    chosen = choose_categories(with_order(df, order_by), split_column, selected_categories)
    columns, descending = [split_column], [False]
    if secondary_sort_column in df.columns and secondary_sort_column != split_column:
        columns, descending = [*columns, secondary_sort_column], [False, secondary_sort_descending]
    keys = sort_keys(chosen, columns, descending)
    safe = safe_column_name(split_column)
    if export_mode == "sorted_unified":
        counts = category_counts(chosen, split_column)
    else:
        blocks = in_blocks(chosen, *keys)
        runs = stage(
            blocks.groupBy(BLOCK, col(split_column).alias("category")).agg(
                F.count(F.lit(1)).alias("rows"), F.min(SLOT).alias("first")
            )
        )
        counts = runs.groupBy("category").agg(F.sum("rows").alias("rows"))
    total, categories = counts.agg(F.sum("rows"), F.count(F.lit(1))).first()
    if not total:
        raise ValueError("no rows are left for the chosen categories")
    result = {"mode": export_mode, "total_rows": total, "total_categories": categories, "format": fmt}
    if export_mode == "sorted_unified":
        result["path"] = f"{path}/sorted_by_{safe}"
        write_table(_data(chosen.orderBy(*keys), df), result["path"], fmt)
        return result
    result["path"] = f"{path}/by_{safe}"
    if export_mode == "zip":
        names = file_names(counts.select("category"))
        summary = file_summary(counts.join(names, counts["category"].eqNullSafe(names["category"])).select(
            counts["category"], "rows", F.concat("name", F.lit("." + fmt)).alias("file")
        ))
        rows = _numbered(blocks, split_column, runs, names).withColumn("file", F.col("__name"))
        rows = in_index_order(rows, ["file"], rows_per_task(df, total, categories), total)
        write_table(_data(rows, df, "file"), f"{result['path']}/data", fmt, partition_by=["file"])
        result["summary"] = f"{result['path']}/{SUMMARY_FILE}"
        write_table(summary.coalesce(1), result["summary"], "csv")
        return result
    names = sheet_titles(counts.select("category"), (SUMMARY_SHEET,) if include_summary_sheet else ())
    rows = _numbered(blocks, split_column, runs, names)
    sheet_no = (F.floor(F.col("__in_group") / sheet_rows) + 1).cast("int")
    rows = rows.withColumn("sheet_title", F.col("__name")).withColumn("sheet_no", sheet_no)
    rows = in_index_order(rows, ["sheet_title", "sheet_no"], rows_per_task(df, total, categories), total)
    write_table(
        _data(rows, df, "sheet_title", "sheet_no"), f"{result['path']}/data", fmt, partition_by=["sheet_title", "sheet_no"]
    )
    if include_summary_sheet:
        result["summary"] = f"{result['path']}/{SUMMARY_SHEET}"
        write_table(category_summary(counts).drop("is_total").coalesce(1), result["summary"], "csv")
    return result


def _data(rows: DataFrame, df: DataFrame, *extra: str) -> DataFrame:
    return rows.select(*[col(c) for c in df.columns if c != ORDER], *extra)


def _numbered(blocks: DataFrame, split_column: str, runs: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with their place in the whole (``__index``), in their category and the category's name.

    All of it is worked out on the runs, one row per block and category, and
    joined back on both, so that a category of any size is spread over its blocks.
    """
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    in_category = Window.partitionBy("category").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        runs.groupBy(BLOCK)
        .agg(F.sum("rows").alias("n"))
        .select(F.col(BLOCK).alias("__b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    )
    placed = runs.select(
        F.col(BLOCK).alias("__block_of_run"),
        F.col("category").alias("__g"),
        (F.coalesce(F.sum("rows").over(in_category), F.lit(0)) - F.col("first")).alias("__shift"),
    ).join(starts, F.col("__block_of_run") == F.col("__b")).drop("__b")
    named = names.select(F.col("category").alias("__c"), F.col("name").alias("__name"))
    placed = placed.join(named, F.col("__g").eqNullSafe(F.col("__c"))).drop("__c")
    rows = blocks.join(
        placed, (F.col(BLOCK) == F.col("__block_of_run")) & col(split_column).eqNullSafe(F.col("__g"))
    )
    return rows.withColumn("__index", F.col("__start") + F.col(SLOT)).withColumn(
        "__in_group", F.col("__shift") + F.col(SLOT)
    )


def read_categories(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    """Read the data of a split back; ``schema`` names the columns and the folder columns."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, escape='"')
    return reader.format(fmt).load(f"{path}/data")
