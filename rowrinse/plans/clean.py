"""The cleaning request as a chain of transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowrinse.functions.text import (
    amount,
    col,
    collapse_spaces,
    collapse_whitespace,
    is_text,
    strip,
    title_case_tokens,
    with_casing,
)
from rowrinse.operators import columns as columns_
from rowrinse.operators import rows as rows_
from rowrinse.operators.dedupe import dedupe, dedupe_rows_normalized
from rowrinse.operators.impute import blanks_to_null, fill_missing
from rowrinse.operators.match import match_keys
from rowrinse.operators.ordering import ORDER, data_columns, sort_rows, with_order
from rowrinse.operators.summary import numeric_likeness
from rowrinse.options import CleaningOptions


def clean(
    df: DataFrame,
    options: CleaningOptions,
    order_by: Sequence[str] | None = None,
    match_list: DataFrame | None = None,
) -> DataFrame:
    """Run a cleaning request.

    ``order_by`` names the columns that give the row order (they need not be
    selected); without it the order is that of the files ``df`` was read from.
    ``match_list`` is a one-column table to use in place of ``bulk_match_values``.
    Steps that are not asked for add nothing to the plan.
    """
    names = options.rename_columns or {}
    if _needs_order(options):
        df = with_order(df, order_by)
    df = columns_.select_columns(df, options.selected_columns)
    df = columns_.rename_columns(df, options.rename_columns)
    df = _drop_columns(df, options)
    df = _drop_rows(df, options)
    df = scrub(df, options)
    if options.clean_numeric_symbols:
        df = clean_amounts(df, columns_.resolve(options.numeric_target_columns, df, names) or options.numeric_target_columns)
    for column in columns_.resolve([options.bulk_match_column or ""], df, names):
        keys = match_list if match_list is not None else options.bulk_match_values
        df = match_keys(df, column, keys, options.bulk_match_mode, options.bulk_match_type)
    df = rows_.apply_rules(df, options.filter_rules, names)
    if options.remove_duplicates:
        chosen = columns_.resolve(options.duplicate_columns, df, names)
        df = dedupe(df, options.dedupe_names_mode or "unique_person", chosen, options.duplicate_keep)
    if options.fill_nulls_mode:
        targets = columns_.resolve(options.fill_nulls_columns, df, names) if options.fill_nulls_columns else None
        if targets is None or targets:
            df = blanks_to_null(df, targets) if options.treat_blank_as_null else df
            df = fill_missing(df, options.fill_nulls_mode, options.fill_nulls_custom_value, targets)
    if options.sort_columns:
        sort_by = [(columns_.resolve([c], df, names) or [c])[0] for c in options.sort_columns]
        df = sort_rows(df, sort_by, options.sort_descending, options.sort_nulls_last)
    return df.drop(ORDER)


def _needs_order(options: CleaningOptions) -> bool:
    auto_amounts = options.clean_numeric_symbols and not options.numeric_target_columns
    carried = (options.fill_nulls_mode or "").lower() in ("forward", "backward")
    return bool(options.remove_duplicates or auto_amounts or carried or options.sort_columns)


def _drop_columns(df: DataFrame, options: CleaningOptions) -> DataFrame:
    if options.drop_col_if_any_null:
        return columns_.drop_columns_with_blanks(df)
    if options.remove_all_blank_columns or options.blank_column_threshold_pct is not None:
        return columns_.drop_blank_columns(df, options.blank_column_threshold_pct)
    return df


def _drop_rows(df: DataFrame, options: CleaningOptions) -> DataFrame:
    """Only the strictest row rule that is asked for runs."""
    if options.drop_row_if_any_null:
        return rows_.drop_rows(df, "any")
    if options.drop_rows_with_null_in_cols:
        required = columns_.resolve(options.drop_rows_with_null_in_cols, df, options.rename_columns)
        return rows_.drop_rows(df, (options.drop_null_mode or "any").lower(), required)
    if options.remove_all_blank_rows:
        return rows_.drop_rows(df, "all")
    return df


def scrub(df: DataFrame, options: CleaningOptions) -> DataFrame:
    """Trim, collapse spaces, then change case.

    Only text columns change, unless ``stringify`` asks for every touched
    column as text.
    """
    if not (options.trim_whitespace or options.collapse_multiple_spaces or options.text_casing):
        return df
    cased = columns_.resolve(options.casing_target_columns, df, options.rename_columns) or data_columns(df)
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        everywhere = options.trim_whitespace or options.collapse_multiple_spaces or field.name in cased
        if field.name == ORDER or not (is_text(field.dataType) or (options.stringify and everywhere)):
            out.append(c)
            continue
        text = c.cast("string")
        if options.trim_whitespace:
            text = strip(text)
        if options.collapse_multiple_spaces:
            text = collapse_spaces(text)
        if options.text_casing and field.name in cased:
            text = with_casing(text, options.text_casing)
        out.append(text.alias(field.name))
    return df.select(*out)


def clean_amounts(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Turn amounts in text into doubles; without columns, into those that look like amounts."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if columns:
        targets = {c for c in columns if c in types and is_text(types[c])}
    else:
        likeness = numeric_likeness(df)
        targets = {r["column"] for r in likeness.filter("candidate").select("column").collect()}  # one row per column
    return df.select(*[amount(col(c)).alias(c) if c in targets else col(c) for c in df.columns])


def clean_lite(df: DataFrame, options: CleaningOptions, order_by: Sequence[str] | None = None) -> DataFrame:
    """The short form of the request.

    Blank rows and required columns both apply; spaces collapse across line
    breaks; title case works on tokens; repeats are whole rows compared
    trimmed and lower-cased, with null and blank alike. No amounts, key list,
    rules, fills or sort.
    """
    df = with_order(df, order_by) if options.remove_duplicates else df
    df = columns_.select_columns(df, options.selected_columns)
    df = columns_.rename_columns(df, options.rename_columns)
    if options.remove_all_blank_columns:
        df = columns_.drop_blank_columns(df)
    if options.remove_all_blank_rows:
        df = rows_.drop_rows(df, "all")
    if options.drop_rows_with_null_in_cols:
        required = columns_.resolve(options.drop_rows_with_null_in_cols, df, options.rename_columns)
        df = rows_.drop_rows(df, "all" if options.drop_null_mode == "all" else "any", required)
    cased = columns_.resolve(options.casing_target_columns, df, options.rename_columns) or data_columns(df)
    df = df.select(*[_lite_cell(df, f, options, f.name in cased) for f in df.schema.fields])
    if options.remove_duplicates:
        df = dedupe_rows_normalized(df)
    return df.drop(ORDER)


def _lite_cell(df: DataFrame, field, options: CleaningOptions, cased: bool):
    c = col(field.name)
    if field.name == ORDER or not (is_text(field.dataType) or options.stringify):
        return c
    text = c.cast("string")
    if options.trim_whitespace:
        text = strip(text)
    if options.collapse_multiple_spaces:
        text = collapse_whitespace(text)
    casing = (options.text_casing or "").lower() if cased else ""
    if "upper" in casing:
        text = F.upper(text)
    elif "lower" in casing:
        text = F.lower(text)
    elif "title" in casing:
        text = title_case_tokens(text)
    return text.alias(field.name)
