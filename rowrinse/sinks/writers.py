"""Writing a table whole or in fixed-size segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.text import col
from rowrinse.operators.ordering import BLOCK, ORDER, SLOT, in_blocks, sort_keys, with_order, with_row_index
from rowrinse.session import leaves_no_scratch

# A sheet's row limit, and names and size of the segments beyond it.
SHEET_ROWS_MAX = 1_048_500
SEGMENT_ROWS = 1_000_000
SHEET_NAME = "Cleaned_Data"
SEGMENT_NAME = "Cleaned_Data_Part_{}"

FORMATS = ("csv", "tsv", "parquet", "json")

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, for formats that hold text only."""
    return df.select(
        *[
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, _NESTED) else col(f.name)
            for f in df.schema.fields
        ]
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    delimiter: str = ",",
    mode: str = "error",
    partition_by: Sequence[str] = (),
) -> None:
    """Write as CSV, TSV, zstd Parquet or JSON lines."""
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; formats: {', '.join(FORMATS)}")
    if fmt in ("csv", "tsv"):
        df = flat(df)
    writer: DataFrameWriter = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.options(
            header=True,
            sep="\t" if fmt == "tsv" else delimiter,
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)


@leaves_no_scratch
def write_segments(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    sort_by: Sequence[str] = (),
    descending: Sequence[bool] | None = None,
    order_by: Sequence[str] | None = None,
    sheet_rows: int = SHEET_ROWS_MAX,
    segment_rows: int = SEGMENT_ROWS,
) -> dict:
    """Write in row order as sheets of bounded length, one folder per sheet.

    A table within ``sheet_rows`` is one sheet; a longer one is cut every
    ``segment_rows`` rows. The folders are named by a column ``sheet``, with a
    number where the table has one of that name.
    """
    ordered = with_order(df, order_by)
    keys = sort_keys(ordered, sort_by, descending) or [F.col(ORDER).asc()]
    blocks = in_blocks(ordered, *keys)
    indexed = with_row_index(blocks, "__index")
    total = blocks.count()
    if total <= sheet_rows:
        sheet = F.lit(SHEET_NAME)
    else:
        number = F.floor(F.col("__index") / segment_rows) + 1
        sheet = F.concat(F.lit(SEGMENT_NAME.format("")), number.cast("string"))
    folder = free_name(df, "sheet")
    rows = in_index_order(indexed.withColumn(folder, sheet), [folder], segment_rows, total)
    write_table(rows.drop("__index", ORDER, BLOCK, SLOT), path, fmt, partition_by=[folder])
    return {"rows": total, "sheets": 1 if total <= sheet_rows else -(-total // segment_rows)}


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with a number where the table has such a column: folder columns never replace data."""
    taken, free, n = {c.lower() for c in df.columns}, name, 1
    while free.lower() in taken:
        free, n = f"{name}_{n}", n + 1
    return free


def in_index_order(df: DataFrame, units: Sequence[str], rows_per_part: int, total: int) -> DataFrame:
    """Lay rows out so that file order is ``__index`` order, ``rows_per_part`` rows to a task."""
    part = F.floor(F.col("__index") / rows_per_part).cast("int")
    return df.repartitionById(max(-(-total // rows_per_part), 1), part).sortWithinPartitions(*units, "__index")


def rows_per_task(df: DataFrame, total: int, units: int) -> int:
    """Rows to a task when ``units`` folders are written: at most a segment, fewer where cores would idle."""
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, units)
    return max(min(SEGMENT_ROWS, -(-total // max(tasks, 1))), 1)
