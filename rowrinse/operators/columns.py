"""Choosing, renaming and dropping columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowrinse.functions.text import blank, col
from rowrinse.operators.ordering import HELPERS, data_columns


def _keep(df: DataFrame, names: Sequence[str]) -> DataFrame:
    helpers = [c for c in df.columns if c in HELPERS]
    return df.select(*[col(c) for c in [*names, *helpers]])


def select_columns(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """The named columns in the given order; unknown names are left out."""
    known = [c for c in dict.fromkeys(names or ()) if c in data_columns(df)]
    return _keep(df, known) if known else df


def invert_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every column that is not named."""
    rest = [c for c in data_columns(df) if c not in set(names)]
    return _keep(df, rest) if rest else df


def rename_columns(df: DataFrame, renames: Mapping[str, str] | None) -> DataFrame:
    """Rename by map; unknown columns and blank targets are left alone."""
    valid = {k: v for k, v in (renames or {}).items() if k in data_columns(df) and v and v.strip()}
    return df.withColumnsRenamed(valid) if valid else df


def resolve(names: Sequence[str] | None, df: DataFrame, renames: Mapping[str, str] | None = None) -> list[str]:
    """Columns by their present or their former name, unknown ones left out."""
    known = data_columns(df)
    found = [n if n in known else (renames or {}).get(n) for n in names or ()]
    return list(dict.fromkeys(n for n in found if n in known))


def blank_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and blank cells per column, all columns in one pass."""
    names = data_columns(df)
    schema = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(blank(col(c), schema[c])).alias(f"b{i}") for i, c in enumerate(names)]
    ).first()
    return row["n"], {c: row[f"b{i}"] for i, c in enumerate(names)}


def blank_columns(df: DataFrame, threshold_pct: float | None = None) -> list[str]:
    """Columns that are wholly blank, or blank in at least ``threshold_pct`` % of the rows."""
    rows, blanks = blank_counts(df)
    limit = 100.0 if threshold_pct is None else threshold_pct
    return [c for c, n in blanks.items() if rows and n / rows * 100.0 >= limit]


def drop_blank_columns(df: DataFrame, threshold_pct: float | None = None) -> DataFrame:
    """Drop :func:`blank_columns`, unless nothing would remain."""
    gone = set(blank_columns(df, threshold_pct))
    rest = [c for c in data_columns(df) if c not in gone]
    return _keep(df, rest) if gone and rest else df


def drop_columns_with_blanks(df: DataFrame) -> DataFrame:
    """Drop every column with a blank cell, unless nothing would remain."""
    rows, blanks = blank_counts(df)
    rest = [c for c, n in blanks.items() if not n]
    return _keep(df, rest) if rows and rest else df


def default_selection(df: DataFrame) -> list[str]:
    """The columns that hold anything."""
    gone = set(blank_columns(df))
    return [c for c in data_columns(df) if c not in gone]
