"""Profiles, counts, labels and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.fixtures import fixture, fixture_sql, table
from registry.sqltext import amount, blank, strip
from rowrinse.functions.labels import size_text
from rowrinse.functions.text import col
from rowrinse.operators.columns import drop_blank_columns
from rowrinse.operators.ordering import with_order
from rowrinse.operators.rows import drop_rows
from rowrinse.operators.summary import (
    before_after,
    category_counts,
    category_summary,
    column_statistics,
    distinct_total,
    duplicate_rows,
    numeric_likeness,
    sample_values,
    source_size,
    table_shape,
    text_statistics,
    value_counts,
)
from rowrinse.session import scratch_path
from rowrinse.plans.profile import preview, profile, report_extract, size_label
from rowrinse.sinks.category import file_names, sheet_titles

CUSTOMER = fixture_sql("dirty_customer")
EVENTS = fixture_sql("dirty_events")
PEOPLE = fixture_sql("dirty_people")
ORDERS = fixture_sql("category_orders")
PART = fixture_sql("dirty_part").replace("with ", "with recursive ", 1)

CUSTOMER_TYPES = {
    **{c: "string" for c in ("cust_id", "full_name", "blank_a", "blank_b", "mostly_blank", "email", "amount", "segment")},
    "nation_key": "int",
}
LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _blank_as_text(c: str) -> str:
    return blank(f"cast({c} as string)")


def _statistics_sql(prefix: str, source: str, types: dict[str, str], digits: int = 2, extra: str = "") -> str:
    parts = []
    for i, (c, t) in enumerate(types.items()):
        parts.append(
            f"select {i} as position, '{c}' as column, '{t}' as dtype, count(*) filter ({_blank_as_text(c)}) as blank_count,"
            f" coalesce(round(100.0 * count(*) filter ({_blank_as_text(c)}) / count(*), {digits}), 0) as blank_pct,"
            f" count(distinct {c}) + cast(count(*) > count({c}) as bigint) as distinct_count,"
            f" count(*) filter ({_blank_as_text(c)}) = count(*) and count(*) > 0 as is_blank{extra.format(c=c)}"
            f" from {source}"
        )
    return prefix + "\nunion all ".join(parts)


def _samples(source: str, order: str) -> str:
    return (
        f", coalesce((select list(v order by o) from (select cast({{c}} as string) as v, {order} as o from {source}"
        " where not (cast({c} as string) is null or trim(cast({c} as string), ' ' || chr(9)) = '')"
        f" order by {order} limit 4)), []) as samples"
    )


def _profile_columns(spark, sf):
    return profile(fixture(spark, sf, "dirty_customer"), order_by=["cust_id"]).columns


def _profile_table(spark, sf):
    return profile(fixture(spark, sf, "dirty_people").drop("person_id"), order_by=["city"]).table


def _profile_lines(spark, sf):
    return column_statistics(table(spark, sf, "lineitem"))


def _profile_approximate(spark, sf):
    return column_statistics(table(spark, sf, "lineitem"), exact=False).drop("distinct_count")


def _samples_only(spark, sf):
    return sample_values(fixture(spark, sf, "dirty_events"), order_by=["event_id"]).drop("position")


def _change(spark, sf):
    raw = fixture(spark, sf, "dirty_customer").drop("cust_id")
    return before_after(raw, drop_rows(drop_blank_columns(raw), "all"))


def _safe_preview(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "value", F.array("user_id", "event_id").alias("ids"))
    odd = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("-inf")).otherwise(F.col("value"))
    return preview(with_order(df.withColumn("value", odd), ["event_id"]), 200).drop("__row_order")


def _report(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    cells, _ = report_extract(_with_gaps(df), 1500, list(df.columns))
    return cells


def _with_gaps(df):
    odd = F.when(F.col("l_linenumber") == 2, float("nan")).when(F.col("l_linenumber") == 3, float("inf"))
    return df.withColumn("l_quantity", odd.when(F.col("l_linenumber") != 4, F.col("l_quantity") + 0.5))


def _report_meta(spark, sf):
    return report_extract(table(spark, sf, "lineitem"), 15_000)[1].unionAll(report_extract(table(spark, sf, "part"))[1])


def _source_size(spark, sf):
    """The size of one text column, written as plain lines."""
    path = scratch_path(spark)
    table(spark, sf, "customer").select("c_name").write.option("compression", "none").text(path)
    return source_size(spark.read.text(path)).select("size_bytes")


BYTES = "n_chars * case doc_id % 6 when 0 then 1 when 1 then 64 when 2 then 1000000 when 3 then 1000000000 when 4 then 1000000000000 else 10000000000000 end"
_UNITS = ("B", "KB", "MB", "GB", "TB")
SIZE_SQL = (
    f"select doc_id, size_bytes, case "
    + " ".join(
        f"when size_bytes < {1024 ** (i + 1)} then printf('%.1f', size_bytes / {1024.0**i}) || ' {u}'"
        for i, u in enumerate(_UNITS)
    )
    + f" else printf('%.1f', size_bytes / {1024.0**5}) || ' PB' end as size"
    f" from (select doc_id, {BYTES} as size_bytes from documents)"
)


def _names(form):
    return lambda spark, sf: form(
        fixture(spark, sf, "dirty_part").select(F.col("label").alias("category")).distinct()
    )


def _names_sql(base: str, candidate: str, reserved: str) -> str:
    """The names given one category after the other."""
    return (
        f"{PART}, cats as (select label as category, {base} as base, row_number() over (order by label nulls last) as i"
        " from (select distinct label from dirty_part)),"
        f" step as (select 0 as i, cast(null as string) as category, cast(null as string) as base, cast(null as string) as name,"
        f" {reserved} as seen union all"
        " select i, category, base, name, list_append(seen, lower(name)) from (select c.i, c.category, c.base,"
        f" list_filter(list_transform(range(0, 400), lambda k: {candidate}), lambda x: not list_contains(s.seen, lower(x)))[1]"
        " as name, s.seen from step s join cats c on c.i = s.i + 1))"
        " select category, base, name from step where i > 0"
    )


_RAW = strip("coalesce(label, '')")
_LEGAL = f"trim(trim(regexp_replace({_RAW}, '[\\\\/*?:\\[\\]]', '_', 'g'), ''''))"
TITLES_SQL = _names_sql(
    f"case when {_RAW} = '' or lower({_RAW}) in ('null', 'none', 'nan') then 'Blank_Unspecified'"
    f" when {_LEGAL} = '' then 'Category' else {_LEGAL} end",
    "case when k = 0 then c.base[1:31] else c.base[1:31 - length('_' || k)] || '_' || k end",
    "['overview_summary']",
)
_SAFE = f"trim(regexp_replace(case when {_RAW} = '' then 'Blank_Unspecified' else {_RAW} end, '[^a-zA-Z0-9_\\- ]', '_', 'g'))[1:50]"
FILES_SQL = _names_sql(
    f"case when {_SAFE} = '' then 'Category' else {_SAFE} end",
    "case when k = 0 then c.base else c.base || '_' || k end",
    "cast([] as varchar[])",
)

_STATUS_LABEL = f"case when {blank('status')} then '(Blank / Unspecified)' else {strip('status')} end"

QUERIES = {
    "profile_columns": (
        _profile_columns,
        _statistics_sql(CUSTOMER, "dirty_customer", CUSTOMER_TYPES, extra=_samples("dirty_customer", "cust_id")),
    ),
    "profile_table": (
        _profile_table,
        f"{PEOPLE}select (select count(*) from dirty_people) as total_rows, 4 as total_cols,"
        " cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as duplicate_rows from (select count(*) as n from dirty_people"
        " group by first_name, last_name, full_name, city)",
    ),
    "profile_lines": (_profile_lines, _statistics_sql("", "lineitem", LINE_TYPES)),
    "profile_approximate": (
        _profile_approximate,
        f"select * exclude (distinct_count) from ({_statistics_sql('', 'lineitem', LINE_TYPES)})",
    ),
    "profile_short": (
        lambda spark, sf: text_statistics(fixture(spark, sf, "dirty_customer")),
        "select * exclude (position) replace ('String' as dtype) from ("
        + _statistics_sql(CUSTOMER, "dirty_customer", CUSTOMER_TYPES, 1)
        + ")",
    ),
    "table_shape": (
        lambda spark, sf: table_shape(table(spark, sf, "orders")),
        "select count(*) as total_rows, 6 as total_cols from orders",
    ),
    "column_distinct": (
        lambda spark, sf: distinct_total(fixture(spark, sf, "dirty_events"), "units"),
        f"{EVENTS}select count(distinct units) + cast(count(*) > count(units) as bigint) as total_unique from dirty_events",
    ),
    "duplicate_rows": (
        lambda spark, sf: duplicate_rows(table(spark, sf, "documents").drop("doc_id")),
        "select cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as duplicate_rows from (select count(*) as n from documents"
        " group by text, lang, source, n_chars)",
    ),
    "value_counts": (
        lambda spark, sf: value_counts(fixture(spark, sf, "dirty_customer"), "email", 40),
        f"{CUSTOMER}select case when {blank('email')} then '' else {strip('email')} end as value,"
        f" case when {blank('email')} then '(Blank / Unspecified)' else {strip('email')} end as display, count"
        " from (select email, count(*) as count from dirty_customer group by email order by count desc, email nulls first limit 40)",
    ),
    "value_counts_untrimmed": (
        lambda spark, sf: value_counts(fixture(spark, sf, "category_orders"), "status"),
        f"{ORDERS}select case when {blank('status')} then '' else {strip('status')} end as value, {_STATUS_LABEL} as display,"
        " count from (select status, count(*) as count from category_orders group by status)",
    ),
    "category_summary": (
        lambda spark, sf: category_summary(category_counts(fixture(spark, sf, "category_orders"), "status")),
        f"{ORDERS}select {_STATUS_LABEL} as category, n as total_records,"
        " n / (select count(*) from category_orders) as share, false as is_total from"
        " (select status, count(*) as n from category_orders group by status) union all"
        " select 'TOTAL', count(*), 1.0, true from category_orders",
    ),
    "before_after": (
        _change,
        f"{CUSTOMER}, c as (select count(*) as b, count(*) filter (c_custkey % 50 <> 0) as a from customer)"
        " select b as rows_before, 8 as cols_before, a as rows_after, 6 as cols_after, b - a as removed_rows,"
        " 2 as removed_cols, round(100.0 * (b - a) / b, 1) as row_change_pct,"
        " ['full_name', 'mostly_blank', 'email', 'amount', 'segment', 'nation_key'] as columns from c",
    ),
    "sample_values": (
        _samples_only,
        f"{EVENTS}"
        + "\nunion all ".join(
            f"select '{c}' as column{_samples('dirty_events', 'event_id').format(c=c)}"
            for c in ("event_id", "event_type", "value", "units", "note")
        ),
    ),
    "numeric_likeness": (
        lambda spark, sf: numeric_likeness(
            fixture(spark, sf, "dirty_customer").select("cust_id", "full_name", "amount", "segment", "mostly_blank")
        ),
        f"{CUSTOMER}"
        + "\nunion all ".join(
            f"select '{c}' as column, count(*) as sampled, count(v) as numeric, count(v) / count(*) as numeric_share,"
            f" count(v) / count(*) >= 0.6 or ({'true' if c == 'amount' else 'false'} and count(v) > 0 and count(v) = count(*)) as candidate"
            f" from (select {amount(c)} as v from dirty_customer where {c} is not null)"
            for c in ("cust_id", "full_name", "amount", "segment", "mostly_blank")
        ),
    ),
    "safe_preview": (
        _safe_preview,
        "select event_id, case when microsecond(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S')"
        " else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as ts,"
        " case when event_id % 3 <> 0 and event_id % 5 <> 0 then value end as value,"
        " '[' || user_id || ',' || event_id || ']' as ids from events order by event_id limit 200",
    ),
    "report_extract": (
        _report,
        "select cast(l_orderkey as string) as l_orderkey, cast(l_linenumber as string) as l_linenumber,"
        " cast(l_partkey as string) as l_partkey, cast(l_suppkey as string) as l_suppkey,"
        " case when l_linenumber in (2, 3, 4) then '' else cast(l_quantity + 0.5 as string) end as l_quantity, l_returnflag"
        " from (select * from (select *, case when l_linenumber = 2 then 'nan'::double when l_linenumber = 3 then"
        " 'inf'::double when l_linenumber <> 4 then l_quantity end as q from lineitem) order by l_orderkey, l_linenumber,"
        " l_partkey, l_suppkey, q nulls last, l_returnflag limit 1500)",
    ),
    "report_message": (
        _report_meta,
        "select n as total_rows, 11 as total_cols, least(n, 15000) as shown_rows, n > 15000 as truncated"
        " from (select count(*) as n from lineitem) union all select n, 6, n, false from (select count(*) as n from part)",
    ),
    "format_size": (
        lambda spark, sf: table(spark, sf, "documents").selectExpr("doc_id", f"{BYTES} as size_bytes").withColumn(
            "size", size_text(col("size_bytes"))
        ),
        SIZE_SQL,
    ),
    "source_size": (
        _source_size,
        "select cast(sum(octet_length(encode(c_name))) + count(*) as bigint) as size_bytes from customer",
    ),
    "safe_sheet_title": (_names(sheet_titles), TITLES_SQL),
    "safe_file_name": (_names(file_names), FILES_SQL),
}
