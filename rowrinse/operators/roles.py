"""Which columns play which part, judged by their names."""

from __future__ import annotations

import re
from collections.abc import Sequence

# The name patterns of each role (all case-insensitive).
FIRST_NAME = r"^(first[_\s]?name|first)$"
FIRST_NAME_LOOSE = r"first[_\s]?name"
LAST_NAME = r"^(last[_\s]?name|last)$"
FULL_NAME = r"^(full[_\s]?name|full_name)$"
FULL_NAME_LOOSE = r"^(full[_\s]?name|full_name|name)$"
ANY_NAME = r"name"
MONEY = r"amount|price|cost|salary|fee|total|paid|rate|balance|revenue|tax|payment"
KEY = r"id|email|code|sku|phone"
SECONDARY_SORT = r"full\s*name|first\s*name|name|company"
SORT_FIRST_NAME = r"first\s*name"
SORT_LAST_NAME = r"last\s*name"
CATEGORY_CHOICE = (
    r"^(location[_\s]?country|company[_\s]?location[_\s]?country|country|countries)$",
    r"country",
    r"nation",
    r"region|state|province",
    r"city|locality",
    r"industry|department|category|status",
)
GEOGRAPHIC = r"country|nation|region|state|city|locality"
CATEGORICAL = r"industry|department|status|category|sector"


def _first(columns: Sequence[str], *patterns: str) -> str | None:
    """The first column that the earliest fitting pattern finds."""
    for pattern in patterns:
        for name in columns:
            if re.search(pattern, name, re.IGNORECASE):
                return name
    return None


def name_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.search(ANY_NAME, c, re.IGNORECASE)]


def looks_like_money(column: str) -> bool:
    return re.search(MONEY, column, re.IGNORECASE) is not None


def _person(columns: Sequence[str], full_pattern: str) -> list[str]:
    first, last = _first(columns, FIRST_NAME), _first(columns, LAST_NAME)
    full = _first(columns, full_pattern)
    if first and last:
        return [first, last]
    return [full] if full else []


def dedupe_keys(columns: Sequence[str], mode: str, chosen: Sequence[str] = ()) -> list[str] | None:
    """Key columns of a dedupe mode; None means whole rows, compared as they are."""
    given = [c for c in chosen if c in columns]
    if mode == "all_columns":
        keys: list[str] = []
    elif mode == "unique_first_name":
        found = _first(columns, FIRST_NAME, FIRST_NAME_LOOSE, ANY_NAME)
        keys = [found] if found else []
    elif mode == "unique_person":
        alone = _first(columns, FIRST_NAME)
        keys = _person(columns, FULL_NAME) or ([alone] if alone else []) or given or name_columns(columns)
    elif mode == "unique_full_name":
        full = _first(columns, FULL_NAME_LOOSE)
        keys = [full] if full else name_columns(columns)
    else:
        keys = given or _person(columns, FULL_NAME_LOOSE) or name_columns(columns)
    return keys or None


def dedupe_preset(columns: Sequence[str], preset: str) -> list[str]:
    """Key columns of a quick choice: ``people``, ``first_name`` or ``all`` (no columns)."""
    if preset == "all" or not columns:
        return []
    lowered = {c: c.lower() for c in columns}
    if preset == "people":
        found = [c for c, n in lowered.items() if "first name" in n or "last name" in n or n in ("full name", "name")]
    else:
        found = [c for c, n in lowered.items() if "first name" in n or n in ("first", "name")]
    return found or [columns[0]]


def category_column(columns: Sequence[str]) -> str | None:
    """The column to split by: a place if there is one, else a class, else the first."""
    return _first(columns, *CATEGORY_CHOICE) or (columns[0] if columns else None)


def category_kind(column: str) -> str | None:
    if re.search(GEOGRAPHIC, column, re.IGNORECASE):
        return "Geographic"
    return "Category" if re.search(CATEGORICAL, column, re.IGNORECASE) else None


def key_column(columns: Sequence[str]) -> str | None:
    """The column to match a key list against."""
    return _first(columns, KEY) or (columns[0] if columns else None)


def secondary_sort_column(columns: Sequence[str]) -> str | None:
    return _first(columns, SECONDARY_SORT)


def name_sort(columns: Sequence[str], column: str, descending: bool = False) -> tuple[list[str], list[bool]]:
    """Sort keys for one column; a first name is followed by the last name."""
    keys = [column]
    last = _first(columns, SORT_LAST_NAME)
    if re.search(SORT_FIRST_NAME, column, re.IGNORECASE) and last and last != column:
        keys.append(last)
    return keys, [descending] * len(keys)
