"""Filling missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.text import blank, col, is_number, is_text
from rowrinse.operators.ordering import BLOCK, ORDER, SLOT, as_blocks, data_columns, with_order
from rowrinse.operators.rows import as_number
from rowrinse.session import leaves_no_scratch, stage

# A column with this many values or fewer gives its median in one aggregate;
# a longer one is narrowed down first.
EXACT_MEDIAN_ROWS = 1_000_000
_APPROX_ACCURACY = 10_000


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def blanks_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn blank text into null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in (columns or data_columns(df)) if c in types and is_text(types[c])]
    return _replace(df, {c: F.when(~blank(col(c), types[c]), col(c)) for c in names})


def fill_missing(
    df: DataFrame,
    mode: str | None,
    value: str | None = None,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Fill nulls by ``empty_str``, ``custom``, ``zero``, ``forward``, ``backward``, ``mean`` or ``median``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    targets = [c for c in (columns or data_columns(df)) if c in data_columns(df)]
    mode = (mode or "").lower()
    numbers = [c for c in targets if is_number(types[c])]
    if mode in ("empty_str", "blank"):
        return _replace(df, {c: F.coalesce(col(c).cast("string"), F.lit("")) for c in targets})
    if mode == "custom" and value is not None:
        return _replace(df, {c: _custom(col(c), types[c], value) for c in targets})
    if mode == "zero":
        filled = {c: F.coalesce(col(c), F.lit(0).cast(types[c])) for c in numbers}
        filled |= {c: F.coalesce(col(c), F.lit("0")) for c in targets if is_text(types[c])}
        return _replace(df, filled)
    if mode in ("forward", "backward") and targets:
        return fill_along(df, targets, forward=mode == "forward", order_by=order_by)
    if mode in ("mean", "median") and numbers:
        found = means(df, numbers) if mode == "mean" else medians(df, numbers)
        return _replace(
            df, {c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in found.items() if v is not None}
        )
    return df


def _custom(c: Column, dtype: T.DataType, value: str) -> Column:
    number = as_number(value)
    if is_number(dtype) and number is not None:
        return F.coalesce(c.cast("double"), F.lit(number))
    return F.coalesce(c.cast("string"), F.lit(value))


def fill_along(
    df: DataFrame, columns: Sequence[str], forward: bool = True, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Carry the nearest earlier (or later) value over nulls, in row order.

    Windows run inside blocks of the order. What enters a block from the blocks
    before it is one row per block, joined on the block the window has already
    partitioned by.
    """
    had_order = ORDER in df.columns
    blocks = as_blocks(with_order(df, order_by))
    # a backward fill is a forward fill in descending order: frames that run to
    # the end of a window are recomputed for every row, running ones are not
    along = (lambda name: F.col(name).asc()) if forward else (lambda name: F.col(name).desc())
    seen = blocks.groupBy(BLOCK).agg(*[_edge_value(c, forward).alias(f"__e{i}") for i, c in enumerate(columns)])
    before = Window.orderBy(along(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.select(
        F.col(BLOCK).alias("__b"), *[_latest(F.col(f"__e{i}")).over(before).alias(f"__c{i}") for i in range(len(columns))]
    )
    within = Window.partitionBy(BLOCK).orderBy(along(SLOT)).rowsBetween(Window.unboundedPreceding, 0)
    filled = _replace(blocks, {c: _latest(col(c)).over(within) for c in columns})
    joined = filled.join(carry, F.col(BLOCK) == F.col("__b"))
    out = _replace(joined, {c: F.coalesce(col(c), F.col(f"__c{i}")) for i, c in enumerate(columns)})
    out = out.drop("__b", BLOCK, SLOT, *[f"__c{i}" for i in range(len(columns))])
    return out if had_order else out.drop(ORDER)


def _latest(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def _edge_value(column: str, forward: bool) -> Column:
    """The last (first) non-null value of a block."""
    at = F.when(col(column).isNotNull(), F.col(SLOT))
    return F.max_by(col(column), at) if forward else F.min_by(col(column), at)


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: None if row[i] is None else float(row[i]) for i, c in enumerate(columns)}


@leaves_no_scratch
def medians(df: DataFrame, columns: Sequence[str], exact_rows: int = EXACT_MEDIAN_ROWS) -> dict[str, float | None]:
    """Exact medians of all columns together, in a few map-side passes.

    A long column is never gathered: approximate quantiles around the middle
    bracket it, counts say which ranks the bracket holds, and the bracket is
    narrowed until few enough values are left to sort.
    """
    narrow = stage(df.select(*[col(c).cast("double").alias(f"m{i}") for i, c in enumerate(columns)]))
    names = narrow.columns
    counts = narrow.agg(*[F.count(n).alias(n) for n in names]).first()
    out: dict[str, float | None] = {n: None for n in names}
    short = [n for n in names if 0 < counts[n] <= exact_rows]
    if short:
        row = narrow.agg(*[F.median(n).alias(n) for n in short]).first()
        out.update({n: row[n] for n in short})
    for n in names:
        if counts[n] > exact_rows:
            ranks = sorted({(counts[n] - 1) // 2, counts[n] // 2})
            values = narrow.select(F.col(n).alias("v")).filter(F.col("v").isNotNull())
            picked = [_value_at_rank(values, r, exact_rows) for r in ranks]
            out[n] = sum(picked) / len(picked)
    return {c: out[n] for c, n in zip(columns, names)}


def _value_at_rank(values: DataFrame, rank: int, exact_rows: int) -> float:
    """The value at a 0-based rank of column ``v``."""
    v = F.col("v")
    while True:
        n = values.count()
        if n <= exact_rows:
            return values.agg(F.sort_array(F.collect_list("v")).alias("s")).select(F.get("s", F.lit(rank))).first()[0]
        share = rank / (n - 1)
        slack = 2.0 / _APPROX_ACCURACY
        low, high = values.agg(
            F.percentile_approx("v", [max(share - slack, 0.0), min(share + slack, 1.0)], _APPROX_ACCURACY)
        ).first()[0]
        below, at_low, inside, at_high = values.agg(
            F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if(v == high)
        ).first()
        if rank < below:
            values = values.filter(v < low)
        elif rank < below + at_low:
            return low
        elif rank < below + at_low + inside:
            values, rank = values.filter((v > low) & (v < high)), rank - below - at_low
        elif rank < below + at_low + inside + at_high and high > low:
            return high
        else:
            skipped = below + at_low + inside + (at_high if high > low else 0)
            values, rank = values.filter(v > high), rank - skipped
