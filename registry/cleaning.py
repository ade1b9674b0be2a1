"""Text, amounts, columns, blank rows, repeats and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.fixtures import fixture, fixture_sql, table
from registry.sqltext import amount, blank, capital, strip, title
from rowrinse.operators.columns import (
    default_selection,
    drop_blank_columns,
    drop_columns_with_blanks,
    invert_columns,
    rename_columns,
    select_columns,
)
from rowrinse.operators.dedupe import dedupe, dedupe_rows, dedupe_rows_normalized
from rowrinse.operators.impute import fill_missing
from rowrinse.operators.ordering import ORDER
from rowrinse.operators.rows import drop_rows
from rowrinse.options import CleaningOptions
from rowrinse.plans.clean import clean_amounts, scrub

CUSTOMER = fixture_sql("dirty_customer")
PEOPLE = fixture_sql("dirty_people")
EVENTS = fixture_sql("dirty_events")

TEXT = ("cust_id", "full_name", "blank_b", "mostly_blank", "email", "amount", "segment")
NAMES = ("cust_id", "full_name", "blank_a", "blank_b", "mostly_blank", "email", "amount", "segment", "nation_key")


def _scrubbed(**options):
    plain = {"trim_whitespace": False, **options}
    return lambda spark, sf: scrub(fixture(spark, sf, "dirty_customer"), CleaningOptions(**plain))


def _each(form, only=TEXT) -> str:
    cells = [f"{form(c)} as {c}" if c in only else c for c in NAMES]
    return f"{CUSTOMER}select {', '.join(cells)} from dirty_customer"


def _customer(step):
    return lambda spark, sf: step(fixture(spark, sf, "dirty_customer"))


def _rows(step):
    """A step on the columns that can all be blank at once."""
    return lambda spark, sf: step(fixture(spark, sf, "dirty_customer").drop("cust_id"))


def _people(step):
    return lambda spark, sf: step(fixture(spark, sf, "dirty_people"))


def _events(step):
    return lambda spark, sf: step(fixture(spark, sf, "dirty_events"))


def _filled(mode, value=None, columns=None):
    return _events(lambda df: fill_missing(df, mode, value, columns, order_by=["event_id"]))


def _first_of(keys: str, keep: str = "first", columns: str = "*") -> str:
    direction = "desc" if keep == "last" else "asc"
    return (
        f"{PEOPLE}select {columns} from dirty_people qualify row_number() over"
        f" (partition by {keys} order by person_id {direction}) = 1"
    )


def _key(c: str) -> str:
    return f"lower({strip(c)})"


def _text_copies(spark, sf):
    return dedupe(table(spark, sf, "documents"), "custom", ["text"], order_by=["doc_id"])


DATA = tuple(n for n in NAMES if n != "cust_id")
DATA_LIST = ", ".join(DATA)
ALL_BLANK = " and ".join(f"{blank(c)}" if c != "nation_key" else "nation_key is null" for c in DATA)
ANY_BLANK = " or ".join(f"{blank(c)}" if c != "nation_key" else "nation_key is null" for c in NAMES if c not in ("blank_a", "blank_b", "mostly_blank"))

FILLED = "event_id, event_type, value, units, note"


def _nearest(function: str, frame: str) -> str:
    cells = [
        f"{function}({c} ignore nulls) over (order by event_id rows between {frame}) as {c}"
        for c in ("event_type", "value", "units", "note")
    ]
    return f"{EVENTS}select event_id, {', '.join(cells)} from dirty_events"


QUERIES = {
    # text
    "trim_text": (_scrubbed(trim_whitespace=True), _each(strip)),
    "collapse_spaces": (
        _scrubbed(collapse_multiple_spaces=True),
        _each(lambda c: f"regexp_replace({c}, '[ \\t]+', ' ', 'g')"),
    ),
    "case_upper": (_scrubbed(text_casing="uppercase"), _each(lambda c: f"upper({c})")),
    "case_lower": (
        _scrubbed(text_casing="lower", casing_target_columns=["full_name", "email"]),
        _each(lambda c: f"lower({c})", ("full_name", "email")),
    ),
    "case_title": (_scrubbed(text_casing="titlecase"), _each(title)),
    "case_capitalize": (_scrubbed(text_casing="sentencecase"), _each(capital)),
    "stringify": (
        _scrubbed(trim_whitespace=True, stringify=True),
        f"{CUSTOMER}select {', '.join(f'{strip(c)} as {c}' for c in TEXT)}, blank_a,"
        " cast(nation_key as string) as nation_key from dirty_customer",
    ),
    # amounts
    "clean_numeric": (
        _customer(lambda df: clean_amounts(df, ["amount"]).select("cust_id", "amount")),
        f"{CUSTOMER}select cust_id, {amount('amount')} as amount from dirty_customer",
    ),
    "clean_numeric_auto": (
        _customer(lambda df: clean_amounts(df.select("cust_id", "amount", "email", "full_name"), order_by=["cust_id"])),
        f"{CUSTOMER}select cust_id, {amount('amount')} as amount, email, full_name from dirty_customer",
    ),
    # columns
    "select_rename": (
        _customer(
            lambda df: rename_columns(
                select_columns(df, ["segment", "cust_id", "no_such", "amount"]), {"segment": "Market Segment", "amount": " "}
            )
        ),
        f'{CUSTOMER}select segment as "Market Segment", cust_id, amount from dirty_customer',
    ),
    "select_invert": (
        _customer(lambda df: invert_columns(df, ["blank_a", "blank_b", "mostly_blank", "email"])),
        f"{CUSTOMER}select cust_id, full_name, amount, segment, nation_key from dirty_customer",
    ),
    "select_default": (
        _customer(lambda df: select_columns(df, default_selection(df))),
        f"{CUSTOMER}select cust_id, full_name, mostly_blank, email, amount, segment, nation_key from dirty_customer",
    ),
    "drop_blank_columns": (
        _customer(drop_blank_columns),
        f"{CUSTOMER}select cust_id, full_name, mostly_blank, email, amount, segment, nation_key from dirty_customer",
    ),
    "drop_columns_threshold": (
        _customer(lambda df: drop_blank_columns(df, 90.0)),
        f"{CUSTOMER}select cust_id, full_name, email, amount, segment, nation_key from dirty_customer",
    ),
    "drop_columns_any_blank": (_customer(drop_columns_with_blanks), f"{CUSTOMER}select cust_id from dirty_customer"),
    # blank rows
    "drop_rows_any_blank": (
        _customer(lambda df: drop_rows(df.drop("blank_a", "blank_b", "mostly_blank"), "any")),
        f"{CUSTOMER}select cust_id, full_name, email, amount, segment, nation_key from dirty_customer where not ({ANY_BLANK})",
    ),
    "drop_rows_required_any": (
        _customer(lambda df: drop_rows(df, "any", ["email", "segment"])),
        f"{CUSTOMER}select * from dirty_customer where not ({blank('email')} or {blank('segment')})",
    ),
    "drop_rows_required_all": (
        _customer(lambda df: drop_rows(df, "all", ["email", "segment"])),
        f"{CUSTOMER}select * from dirty_customer where not ({blank('email')} and {blank('segment')})",
    ),
    "drop_rows_all_blank": (
        _rows(lambda df: drop_rows(df, "all")),
        f"{CUSTOMER}select {DATA_LIST} from dirty_customer where not ({ALL_BLANK})",
    ),
    # repeats
    "dedupe_all_columns": (
        _people(lambda df: dedupe_rows(df.drop("person_id"))),
        f"{PEOPLE}select distinct first_name, last_name, full_name, city from dirty_people",
    ),
    "dedupe_first_name": (
        _people(lambda df: dedupe(df, "unique_first_name", order_by=["person_id"])),
        _first_of(_key("first_name")),
    ),
    "dedupe_person": (
        _people(lambda df: dedupe(df, "unique_person", ["city"], order_by=["person_id"])),
        _first_of(f"{_key('first_name')}, {_key('last_name')}"),
    ),
    "dedupe_person_fallback": (
        _people(lambda df: dedupe(df.select("person_id", "last_name", "city"), order_by=["person_id"])),
        _first_of(_key("last_name"), columns="person_id, last_name, city"),
    ),
    "dedupe_full_name": (
        _people(lambda df: dedupe(df, "unique_full_name", order_by=["person_id"])),
        _first_of(_key("full_name")),
    ),
    "dedupe_custom_first": (
        _people(lambda df: dedupe(df, "custom", ["city", "last_name"], order_by=["person_id"])),
        _first_of(f"{_key('city')}, {_key('last_name')}"),
    ),
    "dedupe_custom_last": (
        _people(lambda df: dedupe(df, "custom", ["city", "last_name"], "last", ["person_id"])),
        _first_of(f"{_key('city')}, {_key('last_name')}", "last"),
    ),
    "dedupe_all_normalized": (
        _people(
            lambda df: dedupe_rows_normalized(
                df.select("first_name", "last_name", "city", F.col("person_id").alias(ORDER))
            ).withColumnRenamed(ORDER, "person_id")
        ),
        _first_of(
            ", ".join(f"lower({strip(f'coalesce({c}, {chr(39) * 2})')})" for c in ("first_name", "last_name", "city")),
            columns="person_id, first_name, last_name, city",
        ),
    ),
    "dedupe_texts": (
        _text_copies,
        "select * from documents qualify row_number() over"
        " (partition by lower(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) order by doc_id) = 1",
    ),
    # fills
    "fill_empty": (
        _filled("empty_str"),
        f"{EVENTS}select cast(event_id as string) as event_id, coalesce(event_type, '') as event_type,"
        " coalesce(cast(value as string), '') as value, coalesce(cast(units as string), '') as units,"
        " coalesce(note, '') as note from dirty_events",
    ),
    "fill_custom": (
        _filled("custom", "2.5", ["event_type", "value", "units"]),
        f"{EVENTS}select event_id, coalesce(event_type, '2.5') as event_type, coalesce(value, 2.5) as value,"
        " coalesce(cast(units as double), 2.5) as units, note from dirty_events",
    ),
    "fill_custom_text": (
        _filled("custom", "none", ["event_type", "units"]),
        f"{EVENTS}select event_id, coalesce(event_type, 'none') as event_type, value,"
        " coalesce(cast(units as string), 'none') as units, note from dirty_events",
    ),
    "fill_zero": (
        _filled("zero"),
        f"{EVENTS}select event_id, coalesce(event_type, '0') as event_type, coalesce(value, 0) as value,"
        " coalesce(units, 0) as units, coalesce(note, '0') as note from dirty_events",
    ),
    "fill_forward": (_filled("forward"), _nearest("last_value", "unbounded preceding and current row")),
    "fill_backward": (_filled("backward"), _nearest("first_value", "current row and unbounded following")),
    # the same in the order of the file, which is that of event_id
    "fill_forward_in_file": (
        _events(lambda df: fill_missing(df, "forward")), _nearest("last_value", "unbounded preceding and current row")),
    "fill_backward_in_file": (
        _events(lambda df: fill_missing(df, "backward")), _nearest("first_value", "current row and unbounded following")),
    "fill_mean": (
        _filled("mean", columns=["value", "units"]),
        f"{EVENTS}select event_id, event_type, coalesce(value, (select avg(value) from dirty_events)) as value,"
        " coalesce(cast(units as double), (select avg(units) from dirty_events)) as units, note from dirty_events",
    ),
    "fill_median": (
        _filled("median", columns=["value", "units"]),
        f"{EVENTS}select event_id, event_type, coalesce(value, (select median(value) from dirty_events)) as value,"
        " coalesce(cast(units as double), (select median(units) from dirty_events)) as units, note from dirty_events",
    ),
}
