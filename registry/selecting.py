"""Key lists, rules, search, category choice, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.fixtures import fixture, fixture_sql, table
from registry.sqltext import blank, strip
from rowrinse.operators.match import match_keys
from rowrinse.operators.ordering import in_blocks, sort_keys, with_order, with_row_index
from rowrinse.operators.roles import name_sort
from rowrinse.operators.rows import apply_rules, choose_categories, search_rows
from rowrinse.plans.profile import preview

MATCH = fixture_sql("keyed_orders", "key_list")
PARTS = fixture_sql("keyed_orders", "part_keys")
WORDS = fixture_sql("word_keys")
CUSTOMER = fixture_sql("dirty_customer")
EVENTS = fixture_sql("dirty_events")
PEOPLE = fixture_sql("dirty_people")

KEYS = f"(select {strip('key')} from key_list where not {blank('key')})"
LOWER_KEYS = f"(select lower({strip('key')}) from key_list where not {blank('key')})"
ANY_PART = "exists (select 1 from part_keys where contains(cust, key))"


def _matched(mode, how, keys="key_list"):
    return lambda spark, sf: match_keys(
        fixture(spark, sf, "keyed_orders"), "cust", fixture(spark, sf, keys), mode, how
    )


def _words(mode):
    return lambda spark, sf: match_keys(
        table(spark, sf, "documents"), "text", fixture(spark, sf, "word_keys"), mode, "contains"
    )


LINES = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
LINE_LIST = ", ".join(LINES)


def _lines(*rules):
    def run(spark, sf):
        wanted = [dict(zip(("column", "op", "val"), r)) for r in rules]
        return apply_rules(table(spark, sf, "lineitem").select(*LINES), wanted)

    return run


BIG = "with b as (select o_orderkey, 9007199254740992 + o_orderkey % 3 as big from orders)"


def _big(*rules):
    def run(spark, sf):
        big = F.lit(9007199254740992) + F.col("o_orderkey") % 3
        wanted = [dict(zip(("column", "op", "val"), r)) for r in rules]
        return apply_rules(table(spark, sf, "orders").select("o_orderkey", big.alias("big")), wanted)

    return run


def _customers(*rules):
    def run(spark, sf):
        wanted = [dict(zip(("column", "op", "val"), r)) for r in rules]
        return apply_rules(fixture(spark, sf, "dirty_customer"), wanted)

    return run


def _where(condition: str, source: str = "lineitem") -> str:
    if source == "lineitem":
        return f"select {LINE_LIST} from lineitem where {condition}"
    return f"{CUSTOMER}select * from dirty_customer where {condition}"


def _placed(df, keys, *columns):
    """Rows with their place in the sorted table."""
    return with_row_index(in_blocks(df, *keys), "place").select(*columns, F.col("place").cast("bigint").alias("place"))


def _sort_multi(spark, sf):
    df = with_order(table(spark, sf, "orders"), ["o_orderkey"])
    return _placed(df, sort_keys(df, ["o_orderpriority", "no_such", "o_totalprice"], [False, False, True]), "o_orderkey")


def _sort_nulls(nulls_last):
    def run(spark, sf):
        df = with_order(fixture(spark, sf, "dirty_events"), ["event_id"])
        return _placed(df, sort_keys(df, ["event_type", "value"], [True], nulls_last), "event_id")

    return run


def _sort_category(spark, sf):
    df = with_order(fixture(spark, sf, "dirty_customer"), ["cust_id"])
    return _placed(df, sort_keys(df, ["segment", "email"], [False, True]), "cust_id")


def _sort_names(spark, sf):
    df = fixture(spark, sf, "dirty_people").withColumnsRenamed({"first_name": "First Name", "last_name": "Last Name"})
    df = with_order(df, ["person_id"])
    return _placed(df, sort_keys(df, *name_sort(df.columns, "First Name", True)), "person_id")


QUERIES = {
    "match_exact_keep": (
        _matched("keep", "exact"), f"{MATCH}select * from keyed_orders where cust in {KEYS}"),
    "match_exact_exclude": (
        _matched("exclude", "exact"), f"{MATCH}select * from keyed_orders where cust not in {KEYS}"),
    "match_ci_keep": (
        _matched("keep", "case_insensitive"), f"{MATCH}select * from keyed_orders where lower(cust) in {LOWER_KEYS}"),
    "match_ci_exclude": (
        _matched("exclude", "case_insensitive"),
        f"{MATCH}select * from keyed_orders where lower(cust) not in {LOWER_KEYS}",
    ),
    "match_contains_keep": (
        _matched("keep", "contains", "part_keys"), f"{PARTS}select * from keyed_orders where {ANY_PART}"),
    "match_contains_exclude": (
        _matched("exclude", "contains", "part_keys"),
        f"{PARTS}select * from keyed_orders where cust is not null and not {ANY_PART}",
    ),
    "match_words_keep": (
        _words("keep"),
        f"{WORDS}select * from documents where exists (select 1 from word_keys where contains(text, {strip('key')}))",
    ),
    "match_words_exclude": (
        _words("exclude"),
        f"{WORDS}select * from documents where not exists (select 1 from word_keys where contains(text, {strip('key')}))",
    ),
    "rule_eq": (_lines(("l_quantity", "=", "5")), _where("l_quantity = 5")),
    "rule_eq_text": (_lines(("l_returnflag", "=", "A")), _where("l_returnflag = 'A'")),
    "rule_ne": (_lines(("l_linenumber", "!=", 1)), _where("l_linenumber <> 1")),
    "rule_ne_text": (
        _customers(("email", "!=", "")), _where("email <> ''", "dirty_customer")),
    "rule_gt": (_lines(("l_extendedprice", ">", "50000")), _where("l_extendedprice > 50000")),
    "rule_ge": (_lines(("l_quantity", ">=", 25)), _where("l_quantity >= 25")),
    "rule_lt": (_lines(("l_quantity", "<", 25)), _where("l_quantity < 25")),
    "rule_le": (_lines(("l_linenumber", "<=", "3"), ("l_quantity", "<", "abc")), _where("l_linenumber <= 3")),
    "rule_gt_text": (
        _customers(("amount", ">", "100")), _where("try_cast(amount as double) > 100 and not contains(amount, ' ')"
        " and not contains(amount, chr(9))", "dirty_customer")),
    "rule_eq_bigint": (_big(("big", "=", "9007199254740993")), f"{BIG} select o_orderkey, big from b where big = 9007199254740993"),
    "rule_range_bigint": (
        _lines(("l_orderkey", "<=", "100.5"), ("l_orderkey", ">", 3), ("l_partkey", "!=", "7.5")),
        _where("l_orderkey <= 100 and l_orderkey > 3"),
    ),
    "match_empty_keys": (
        lambda spark, sf: match_keys(
            fixture(spark, sf, "keyed_orders"), "cust", fixture(spark, sf, "key_list").filter("false"), "exclude", "contains"),
        f"{MATCH}select * from keyed_orders",
    ),
    "rule_contains": (
        _customers(("full_name", "contains", "mr.")), _where("contains(full_name, 'mr.')", "dirty_customer")),
    "rule_starts_with": (
        _customers(("email", "starts_with", "User1")), _where("starts_with(email, 'User1')", "dirty_customer")),
    "rule_ends_with": (
        _customers(("cust_id", "ends_with", "9")), _where("ends_with(cust_id, '9')", "dirty_customer")),
    "rule_is_null": (_customers(("email", "is_null")), _where("email is null", "dirty_customer")),
    "rule_is_not_null": (
        _customers(("mostly_blank", "is_not_null")), _where("mostly_blank is not null", "dirty_customer")),
    "rule_chain": (
        _lines(("l_returnflag", "!=", "N"), ("no_such", "=", 1), ("l_quantity", ">=", 10), ("l_partkey", None),
               ("l_extendedprice", "<", 40000.5)),
        _where("l_returnflag <> 'N' and l_quantity >= 10 and l_extendedprice < 40000.5"),
    ),
    "search_any_cell": (
        lambda spark, sf: search_rows(fixture(spark, sf, "dirty_customer"), "MACHIN"),
        _where(" or ".join(f"contains(lower(coalesce(cast({c} as string), '')), 'machin')" for c in (
            "cust_id", "full_name", "blank_a", "blank_b", "mostly_blank", "email", "amount", "segment", "nation_key"
        )), "dirty_customer"),
    ),
    "category_select": (
        lambda spark, sf: choose_categories(
            fixture(spark, sf, "dirty_customer"), "segment", ["machinery", "BUILDING", "(Blank / Unspecified)"]),
        _where(f"segment in ('machinery', 'BUILDING', '(Blank / Unspecified)') or {blank('segment')}", "dirty_customer"),
    ),
    "category_select_strict": (
        lambda spark, sf: choose_categories(fixture(spark, sf, "dirty_customer"), "nation_key", ["3", "7"]),
        _where("cast(nation_key as string) in ('3', '7')", "dirty_customer"),
    ),
    "sort_multi": (
        _sort_multi,
        "select o_orderkey, row_number() over (order by o_orderpriority nulls last, o_totalprice desc nulls last,"
        " o_orderkey) - 1 as place from orders",
    ),
    "sort_nulls_last": (
        _sort_nulls(True),
        f"{EVENTS}select event_id, row_number() over (order by event_type desc nulls last, value nulls last, event_id) - 1"
        " as place from dirty_events",
    ),
    "sort_nulls_first": (
        _sort_nulls(False),
        f"{EVENTS}select event_id, row_number() over (order by event_type desc nulls first, value nulls first, event_id) - 1"
        " as place from dirty_events",
    ),
    "sort_category": (
        _sort_category,
        f"{CUSTOMER}select cust_id, row_number() over (order by segment nulls last, email desc nulls last, cust_id) - 1"
        " as place from dirty_customer",
    ),
    "sort_names": (
        _sort_names,
        f"{PEOPLE}select person_id, row_number() over (order by first_name desc nulls last, last_name desc nulls last,"
        " person_id) - 1 as place from dirty_people",
    ),
    "preview_top": (
        lambda spark, sf: preview(
            with_order(table(spark, sf, "orders").drop("o_orderdate"), ["o_orderkey"]), 900, ["o_totalprice"], [True]
        ).drop("__row_order"),
        "select * exclude (o_orderdate) from orders order by o_totalprice desc, o_orderkey limit 900",
    ),
}
