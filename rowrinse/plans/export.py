"""Cleaning requests whose result is written: whole, or by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rowrinse.operators.ordering import data_columns
from rowrinse.operators.roles import category_column
from rowrinse.operators.summary import files_size
from rowrinse.options import CleaningOptions
from rowrinse.plans.clean import clean
from rowrinse.plans.profile import size_label
from rowrinse.session import leaves_no_scratch
from rowrinse.sinks.category import write_by_category
from rowrinse.sinks.writers import write_table


def _facts(cleaned: DataFrame, rows: int, path: str) -> dict:
    """What was written, its size by the listing of its files."""
    size = size_label(files_size(cleaned.sparkSession, [path])).first()
    return {"rows": rows, "cols": len(data_columns(cleaned)), "size_bytes": size["size_bytes"], "size": size["size"], "path": path}


@leaves_no_scratch
def clean_and_export(
    df: DataFrame,
    options: CleaningOptions,
    path: str,
    fmt: str = "csv",
    delimiter: str = ",",
    order_by: Sequence[str] | None = None,
    match_list: DataFrame | None = None,
) -> dict:
    """Run a request and write its result; returns rows, columns, bytes and path.

    The pipeline runs once: the rows are counted in what was written.
    """
    cleaned = clean(df, options, order_by, match_list)
    write_table(cleaned, path, fmt, delimiter)
    written = cleaned.sparkSession.read.format({"tsv": "csv"}.get(fmt.lower(), fmt.lower()))
    if fmt.lower() in ("csv", "tsv"):
        written = written.options(header=True, escape='"', multiLine=True, sep="\t" if fmt.lower() == "tsv" else delimiter)
    return _facts(cleaned, written.schema(cleaned.schema if fmt.lower() == "parquet" else "c string").load(path).count(), path)


@leaves_no_scratch
def clean_and_split(
    df: DataFrame,
    options: CleaningOptions,
    path: str,
    split_column: str | None = None,
    export_mode: str = "sheets",
    fmt: str = "csv",
    order_by: Sequence[str] | None = None,
    match_list: DataFrame | None = None,
    **split,
) -> dict:
    """Run a request and write its result by category; ``split_column=None`` takes the column a reader would choose.

    ``order_by`` names columns of the result. Further arguments are those of :func:`write_by_category`.
    """
    cleaned = clean(df, options, order_by, match_list)
    split_column = split_column or category_column(cleaned.columns)
    done = write_by_category(cleaned, split_column, path, export_mode, fmt, order_by=order_by, **split)
    return {**done, **_facts(cleaned, done["total_rows"], done["path"]), "split_column": split_column}
