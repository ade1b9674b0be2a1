"""Row order, sorting, and positions in an order that no single task has to see.

A DataFrame has no row order of its own, so order is always a column: one the
caller names, or ``ORDER`` taken at the scan. Positions and carried values are
found in two steps: the rows are range-partitioned into blocks and written once,
then one small row per block says what the blocks before it hold.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.text import col
from rowrinse.session import stage

ORDER = "__row_order"
BLOCK = "__block"
SLOT = "__slot"
HELPERS = (ORDER, BLOCK, SLOT)

# Rows of a file in one block.
BLOCK_ROWS = 1_000_000


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HELPERS]


def file_order(df: DataFrame) -> Column:
    """The order of rows in the files ``df`` was just read from.

    What is joined or grouped from files has none: the number of a row in its
    task would change from run to run. A table made in memory keeps the order
    in which its tasks hold its rows.
    """
    file = F.col("_metadata.file_path").alias("file")
    if _resolves(df, "_metadata.row_index"):
        return F.struct(file, F.col("_metadata.row_index").alias("row"))
    if _resolves(df, "_metadata.file_block_start"):
        split = F.col("_metadata.file_block_start").alias("split")
        return F.struct(file, split, F.monotonically_increasing_id().alias("line"))
    if df.inputFiles():
        raise ValueError("the rows of this table have no order of their own: name the columns that give it in order_by")
    return F.monotonically_increasing_id()


def _resolves(df: DataFrame, name: str) -> bool:
    log = logging.getLogger("DataFrameQueryContextLogger")
    level = log.level
    log.setLevel(logging.CRITICAL)  # a miss is an answer here, not an error to report
    try:
        df.select(name)
    except AnalysisException:
        return False
    finally:
        log.setLevel(level)
    return True


def with_order(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Add ``ORDER`` from the named columns, or from the files if none are named."""
    if ORDER in df.columns:
        return df
    if not order_by:
        order = file_order(df)
    elif len(order_by) == 1:
        order = col(order_by[0])
    else:
        order = F.struct(*[col(c).alias(f"p{i}") for i, c in enumerate(order_by)])
    return df.select("*", order.alias(ORDER))


def sort_rows(
    df: DataFrame,
    columns: Sequence[str],
    descending: Sequence[bool] | None = None,
    nulls_last: bool = True,
) -> DataFrame:
    """Global sort; unknown columns are left out together with their direction.

    ``ORDER``, if present, breaks ties, which also lets the range partitioner
    split a value that many rows share.
    """
    keys = sort_keys(df, columns, descending, nulls_last)
    return df.orderBy(*keys) if keys else df


def sort_keys(
    df: DataFrame,
    columns: Sequence[str],
    descending: Sequence[bool] | None = None,
    nulls_last: bool = True,
) -> list[Column]:
    directions = list(descending or [])
    directions += [False] * (len(columns) - len(directions))
    keys = []
    for name, down in zip(columns, directions):
        if name not in df.columns:
            continue
        c = col(name)
        if down:
            keys.append(c.desc_nulls_last() if nulls_last else c.desc_nulls_first())
        else:
            keys.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    if keys and ORDER in df.columns:
        keys.append(F.col(ORDER).asc())
    return keys


def head_rows(df: DataFrame, n: int, columns: Sequence[str] = (), descending: Sequence[bool] | None = None) -> DataFrame:
    """The first ``n`` rows in the given order; planned as a top-k, not as a full sort."""
    keys = sort_keys(df, columns, descending) or ([F.col(ORDER)] if ORDER in df.columns else [])
    return (df.orderBy(*keys) if keys else df).limit(n)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by ``ORDER``, for an ``n`` too large to send from every task.

    The smallest value of each task is one of its rows, so the ``n``-th
    smallest of them bounds the first ``n`` rows of the table; what lies beyond
    is filtered out before the top-k. Fewer tasks than ``n`` need no bound.
    """
    smallest = (
        df.select(F.spark_partition_id().alias("task"), F.col(ORDER).alias("at"))
        .groupBy("task")
        .agg(F.min("at").alias("at"))
        .filter(F.col("at").isNotNull())
        .orderBy("at")
        .limit(n)
    )
    bound = smallest.agg(F.when(F.count(F.lit(1)) == n, F.max("at")).alias("bound"))
    return df.filter(F.coalesce(F.col(ORDER) <= bound.scalar(), F.lit(True))).orderBy(ORDER).limit(n)


def in_blocks(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows sorted by ``keys``, cut into contiguous blocks and staged.

    ``BLOCK`` grows with the order; ``SLOT`` is the position inside a block.
    Both are stored, so every later pass sees the same cut.
    """
    ordered = df.orderBy(*keys).withColumn(SLOT, F.monotonically_increasing_id())
    staged = stage(ordered)
    return staged.withColumn(BLOCK, F.shiftright(SLOT, 33)).withColumn(
        SLOT, F.col(SLOT).bitwiseAND(F.lit((1 << 33) - 1))
    )


def as_blocks(df: DataFrame) -> DataFrame:
    """Blocks along ``ORDER``.

    Where ``ORDER`` is a position in a file, blocks are fixed ranges of
    positions and nothing has to be sorted or written to find them.
    """
    dtype = df.schema[ORDER].dataType
    if not isinstance(dtype, T.StructType) or dtype.names != ["file", "row"]:
        return in_blocks(df, F.col(ORDER).asc())
    row = F.col(ORDER)["row"]
    number = F.floor(row / BLOCK_ROWS).alias("number")
    return df.withColumn(BLOCK, F.struct(F.col(ORDER)["file"].alias("file"), number)).withColumn(SLOT, row)


def _blocks_before(partition: Sequence[str] = ()):
    window = Window.partitionBy(*partition) if partition else Window
    return window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def with_row_index(blocks: DataFrame, name: str) -> DataFrame:
    """Number the rows of a table from :func:`in_blocks` from 0, without another shuffle.

    The joined side has one row of two integers per block, at most one block
    per shuffle partition, so it is always small enough to broadcast.
    """
    starts = (
        blocks.groupBy(BLOCK)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(BLOCK, F.coalesce(F.sum("__n").over(_blocks_before()), F.lit(0)).alias("__start"))
    )
    return blocks.join(F.broadcast(starts), BLOCK).withColumn(name, F.col("__start") + F.col(SLOT)).drop("__start")


def with_group_index(blocks: DataFrame, group: str, name: str) -> DataFrame:
    """Number the rows of each group from 0; ``blocks`` must be sorted by ``group`` first.

    A group of any size spans many blocks. The join key is (block, group), so
    no key holds more than one block of rows.
    """
    runs = blocks.groupBy(BLOCK, col(group).alias("__g")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(SLOT).alias("__first")
    )
    starts = runs.select(
        F.col(BLOCK).alias("__b"),
        "__g",
        (F.coalesce(F.sum("__n").over(_blocks_before(["__g"])), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    joined = blocks.join(starts, (F.col(BLOCK) == F.col("__b")) & col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn(name, F.col("__shift") + F.col(SLOT)).drop("__b", "__g", "__shift")
