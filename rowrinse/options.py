"""The cleaning request: one flat, immutable record."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence
from typing import Any


@dataclasses.dataclass(frozen=True)
class CleaningOptions:
    # columns and rows that hold nothing
    remove_all_blank_columns: bool = True
    drop_col_if_any_null: bool = False
    blank_column_threshold_pct: float | None = None
    remove_all_blank_rows: bool = True
    drop_row_if_any_null: bool = False
    drop_rows_with_null_in_cols: Sequence[str] | None = None
    drop_null_mode: str = "any"

    # repeated rows
    remove_duplicates: bool = True
    dedupe_names_mode: str = "unique_person"
    duplicate_columns: Sequence[str] | None = None
    duplicate_keep: str = "first"

    # text and amounts
    trim_whitespace: bool = True
    collapse_multiple_spaces: bool = False
    text_casing: str | None = None
    casing_target_columns: Sequence[str] | None = None
    clean_numeric_symbols: bool = False
    numeric_target_columns: Sequence[str] | None = None

    # missing values
    fill_nulls_mode: str | None = None
    fill_nulls_custom_value: str | None = None
    fill_nulls_columns: Sequence[str] | None = None

    # extraction by a list of keys
    bulk_match_column: str | None = None
    bulk_match_values: Sequence[str] | None = None
    bulk_match_mode: str = "keep"
    bulk_match_type: str = "exact"

    # shape of the result
    selected_columns: Sequence[str] | None = None
    rename_columns: Mapping[str, str] | None = None
    sort_columns: Sequence[str] | None = None
    sort_descending: Sequence[bool] | None = None
    sort_nulls_last: bool = True
    filter_rules: Sequence[Mapping[str, Any]] | None = None

    # ours: see "Differences" in the README
    stringify: bool = False
    treat_blank_as_null: bool = False

    @classmethod
    def from_dict(cls, record: Mapping[str, Any]) -> CleaningOptions:
        """Build from a JSON-like record; unknown fields are an error."""
        return cls(**record)

    def replace(self, **changes: Any) -> CleaningOptions:
        return dataclasses.replace(self, **changes)
