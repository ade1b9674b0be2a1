"""Whole cleaning requests."""

from __future__ import annotations

from registry.fixtures import fixture, fixture_sql
from registry.sqltext import amount, blank, strip, title_tokens
from rowrinse.operators.roles import category_column, secondary_sort_column
from rowrinse.operators.summary import category_counts, category_summary
from rowrinse.options import CleaningOptions
from rowrinse.plans.clean import clean, clean_lite
from rowrinse.plans.profile import clean_and_preview
from rowrinse.session import scratch_path
from rowrinse.sinks.category import write_by_category

EXTRACT = CleaningOptions(
    clean_numeric_symbols=True,
    numeric_target_columns=["amount"],
    bulk_match_column="cust_id",
    selected_columns=["cust_id", "full_name", "amount", "segment"],
    sort_columns=["cust_id"],
    sort_descending=[False],
)

FULL = CleaningOptions(
    selected_columns=["cust_id", "full_name", "mostly_blank", "blank_b", "email", "amount", "segment", "nation_key"],
    rename_columns={"segment": "Market", "cust_id": "Customer", "email": ""},
    blank_column_threshold_pct=90.0,
    drop_rows_with_null_in_cols=["segment", "amount"],
    collapse_multiple_spaces=True,
    text_casing="uppercase",
    casing_target_columns=["segment", "full_name"],
    clean_numeric_symbols=True,
    bulk_match_column="cust_id",
    bulk_match_mode="exclude",
    filter_rules=[
        {"column": "amount", "op": ">=", "val": "100"},
        {"column": "Customer", "op": "starts_with", "val": "CUST-"},
        {"column": "segment", "op": "!=", "val": "HOUSEHOLD"},
    ],
    dedupe_names_mode="custom",
    duplicate_columns=["segment", "nation_key", "amount"],
    duplicate_keep="last",
    fill_nulls_mode="custom",
    fill_nulls_custom_value="(none)",
    fill_nulls_columns=["email"],
    sort_columns=["amount", "cust_id"],
    sort_descending=[True],
)

ORDERED = CleaningOptions(
    remove_duplicates=False,
    filter_rules=[{"column": "event_id", "op": ">", "val": 10}],
    fill_nulls_mode="forward",
    fill_nulls_columns=["event_type", "value", "note"],
    treat_blank_as_null=True,
    sort_columns=["event_id"],
)

MEDIAN = CleaningOptions(
    dedupe_names_mode="all_columns",
    selected_columns=["event_id", "value", "units", "event_type"],
    drop_rows_with_null_in_cols=["event_type", "units"],
    drop_null_mode="all",
    fill_nulls_mode="median",
)

LITE = CleaningOptions(
    selected_columns=["full_name", "blank_a", "email", "segment", "nation_key"],
    rename_columns={"segment": "Market"},
    drop_rows_with_null_in_cols=["Market"],
    collapse_multiple_spaces=True,
    text_casing="titlecase",
    casing_target_columns=["full_name", "Market"],
)

PEOPLE = CleaningOptions(dedupe_names_mode="unique_full_name", text_casing="capitalize")

CUSTOMER = fixture_sql("dirty_customer", "key_list")
KEYS = f"(select {strip('key')} from key_list where not {blank('key')})"


def _extract(spark, sf):
    df = fixture(spark, sf, "dirty_customer")
    return clean(df, EXTRACT, ["cust_id"], fixture(spark, sf, "key_list"))


def _full(spark, sf):
    return clean(fixture(spark, sf, "dirty_customer"), FULL, ["cust_id"], fixture(spark, sf, "key_list"))


def _lite(spark, sf):
    df = fixture(spark, sf, "dirty_customer")
    return clean_lite(df, LITE, ["cust_id"])


def _category(spark, sf):
    """Clean, split by the column a reader would choose, and give the overview."""
    cleaned = clean(fixture(spark, sf, "dirty_people"), PEOPLE, ["person_id"])
    column = category_column(cleaned.columns)
    done = write_by_category(
        cleaned, column, scratch_path(spark), "sorted_unified", "parquet",
        secondary_sort_column=secondary_sort_column(cleaned.columns), order_by=["person_id"])
    return category_summary(category_counts(spark.read.parquet(done["path"]), column))


def _preview(spark, sf):
    return clean_and_preview(fixture(spark, sf, "dirty_customer"), FULL, ["cust_id"], fixture(spark, sf, "key_list"), 20)[0]


def _change(spark, sf):
    df = fixture(spark, sf, "dirty_customer")
    return clean_and_preview(df, FULL.replace(sort_columns=None), ["cust_id"], fixture(spark, sf, "key_list"))[1]


_SQUEEZED = "regexp_replace({}, '[ \\t]+', ' ', 'g')"


def _squeeze(c: str) -> str:
    return _SQUEEZED.format(strip(c))


FULL_SQL = (
    f"{CUSTOMER}, scrubbed as (select {_squeeze('cust_id')} as \"Customer\", upper({_squeeze('full_name')}) as full_name,"
    f" {_squeeze('email')} as email, {amount('amount')} as amount, upper({_squeeze('segment')}) as \"Market\", nation_key"
    f" from dirty_customer where not ({blank('segment')} or {blank('amount')})),"
    f" kept as (select * from scrubbed where \"Customer\" not in {KEYS} and amount >= 100 and"
    " starts_with(\"Customer\", 'CUST-') and \"Market\" <> 'HOUSEHOLD' qualify row_number() over"
    " (partition by lower(\"Market\"), nation_key, amount order by \"Customer\" desc) = 1)"
)

EVENTS = fixture_sql("dirty_events")
_LAST = "last_value({} ignore nulls) over (order by event_id rows between unbounded preceding and current row)"
_SCRUBBED_EVENTS = (
    f"{EVENTS}, e as (select event_id, {strip('event_type')} as event_type, value, units, nullif({strip('note')}, '') as note"
    " from dirty_events where event_id > 10)"
)

QUERIES = {
    "extract_keys": (
        _extract,
        f"{CUSTOMER}select cust_id, {strip('full_name')} as full_name, {amount('amount')} as amount, {strip('segment')} as segment"
        f" from dirty_customer where cust_id in {KEYS} qualify row_number() over (partition by lower({strip('full_name')})"
        " order by cust_id) = 1",
    ),
    "clean_full": (
        _full,
        f"{FULL_SQL} select \"Customer\", full_name, coalesce(email, '(none)') as email, amount, \"Market\", nation_key from kept",
    ),
    "clean_ordered": (
        lambda spark, sf: clean(fixture(spark, sf, "dirty_events"), ORDERED, ["event_id"]),
        f"{_SCRUBBED_EVENTS} select event_id, {_LAST.format('event_type')} as event_type, {_LAST.format('value')} as value,"
        f" units, {_LAST.format('note')} as note from e",
    ),
    "clean_median": (
        lambda spark, sf: clean(fixture(spark, sf, "dirty_events"), MEDIAN),
        f"{EVENTS}, e as (select * from dirty_events where not ({blank('event_type')} and units is null))"
        " select cast(event_id as double) as event_id, coalesce(value, (select median(value) from e)) as value,"
        " coalesce(cast(units as double), (select median(units) from e)) as units, event_type from e",
    ),
    "clean_lite": (
        _lite,
        f"{CUSTOMER}, t as (select cust_id, {strip('full_name')} as n, {strip('email')} as e, {strip('segment')} as s, nation_key"
        f" from dirty_customer where not {blank('segment')}), u as (select cust_id,"
        f" {title_tokens('regexp_replace(n, chr(92) || chr(115) || chr(43), chr(32), chr(103))')} as full_name,"
        f" e as email, {title_tokens('s')} as \"Market\", nation_key from t)"
        " select full_name, email, \"Market\", nation_key from u qualify row_number() over (partition by"
        " lower(coalesce(full_name, '')), lower(coalesce(email, '')), lower(coalesce(\"Market\", '')),"
        " coalesce(cast(nation_key as string), '') order by cust_id) = 1",
    ),
    "clean_category": (
        _category,
        f"{fixture_sql('dirty_people')}, p as (select {strip('city')} as city, {strip('full_name')} as n, person_id from dirty_people),"
        " q as (select person_id, upper(city[1]) || lower(city[2:]) as city from p qualify row_number() over"
        " (partition by lower(n) order by person_id) = 1)"
        " select coalesce(city, '(Blank / Unspecified)') as category, count(*) as total_records,"
        " count(*) / (select count(*) from q) as share, false as is_total from q group by city"
        " union all select 'TOTAL', count(*), 1.0, true from q",
    ),
    "clean_preview": (
        _preview,
        f"{FULL_SQL} select \"Customer\", full_name, coalesce(email, '(none)') as email, amount, \"Market\", nation_key from kept"
        " order by amount desc, \"Customer\" limit 20",
    ),
    "clean_change": (
        _change,
        f"{FULL_SQL}, n as (select (select count(*) from dirty_customer) as b, (select count(*) from kept) as a)"
        " select b as rows_before, 9 as cols_before, a as rows_after, 6 as cols_after, b - a as removed_rows, 3 as removed_cols,"
        " round(100.0 * (b - a) / b, 1) as row_change_pct,"
        " ['Customer', 'full_name', 'email', 'amount', 'Market', 'nation_key'] as columns from n",
    ),
}
