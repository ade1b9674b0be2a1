"""Pieces of DuckDB SQL that the counterparts share."""

from __future__ import annotations

SPACES = "' ' || chr(9) || chr(10) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def blank(x: str) -> str:
    return f"({x} is null or {strip(x)} = '')"


def amount(x: str) -> str:
    return f"try_cast(regexp_replace({x}, '[$,%\\s]', '', 'g') as double)"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+|[^a-z0-9]+'),"
        " lambda w: upper(w[1]) || w[2:]), '')"
    )


def title_tokens(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\w\\S*|\\W+'),"
        " lambda w: case when regexp_matches(w, '^\\w') then upper(w[1]) || lower(w[2:]) else w end), '')"
    )


def capital(x: str) -> str:
    return f"upper({x}[1]) || lower({x}[2:])"
