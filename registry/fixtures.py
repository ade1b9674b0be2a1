"""Dirty tables made from the clean ones.

One definition serves both sides: every expression is plain enough to mean the
same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# name -> columns worked out before the others, each from those above it
PREPARED: dict[str, dict[str, str]] = {
    "dirty_customer": {
        "cents": "abs(cast(round(c_acctbal * 100) as bigint))",
        "whole": "cast((cents - cents % 100) / 100 as bigint)",
        "fraction": "lpad(cast(cents % 100 as string), 2, '0')",
        "sign": "case when c_acctbal < 0 then '-' else '' end",
        "thousands": "cast((whole - whole % 1000) / 1000 as bigint)",
    }
}

_GROUPED = (
    "case when whole >= 1000 then cast(thousands as string) || ',' || lpad(cast(whole % 1000 as string), 3, '0')"
    " else cast(whole as string) end"
)
_K = "cast(c_custkey as string)"

_FIRST = (
    "case c_custkey % 9 when 0 then 'Ann' when 1 then 'ann ' when 2 then ' ANN' when 3 then 'Bob' when 4 then 'bob'"
    " when 5 then chr(9) || 'Carl' when 7 then 'Dora' when 8 then 'dora  ' end"
)
_LAST = (
    "case cast((c_custkey - c_custkey % 9) / 9 as bigint) % 6 when 0 then 'Lee' when 1 then ' lee' when 2 then 'Ray'"
    " when 3 then 'O''Hara' when 5 then 'RAY ' end"
)

# name -> (base table, {column: expression})
FIXTURES: dict[str, tuple[str, dict[str, str]]] = {
    "dirty_customer": (
        "customer",
        {
            "cust_id": f"'CUST-' || {_K}",
            "full_name": (
                "case when c_custkey % 100 = 0 then null when c_custkey % 50 = 0 then '   '"
                " when c_custkey % 4 = 0 then '  ' || c_name || ' '"
                " when c_custkey % 4 = 1 then upper(c_name) || chr(9)"
                " when c_custkey % 4 = 2 then 'mr.  ' || lower(c_name) || chr(9) || chr(9) || 'o-brien'"
                " else c_name end"
            ),
            "blank_a": "cast(null as string)",
            "blank_b": "case when c_custkey % 2 = 0 then '' else '  ' || chr(9) end",
            "mostly_blank": f"case when c_custkey % 20 = 0 and c_custkey % 50 <> 0 then 'x' || {_K} end",
            "email": (
                "case when c_custkey % 50 = 0 or c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then ''"
                f" else 'User' || {_K} || '@Example.com' end"
            ),
            "amount": (
                "case when c_custkey % 50 = 0 then null when c_custkey % 13 = 0 then 'n/a'"
                " when c_custkey % 17 = 0 then '1.5f'"
                f" when c_custkey % 3 = 0 then sign || '$' || {_GROUPED} || '.' || fraction"
                " when c_custkey % 3 = 1 then ' ' || sign || cast(whole as string) || '.' || fraction || ' %'"
                " else sign || cast(whole as string) || chr(9) end"
            ),
            "segment": (
                "case when c_custkey % 50 = 0 then '' when c_custkey % 3 = 0 then '  ' || c_mktsegment || '  '"
                " when c_custkey % 3 = 1 then lower(c_mktsegment) else c_mktsegment end"
            ),
            "nation_key": "case when c_custkey % 50 = 0 then null else c_nationkey end",
        },
    ),
    "dirty_people": (
        "customer",
        {
            "person_id": "c_custkey",
            "first_name": _FIRST,
            "last_name": _LAST,
            "full_name": (
                f"case when c_custkey % 10 = 0 then null when c_custkey % 2 = 0 then upper(coalesce({_FIRST}, ''))"
                f" || ' ' || coalesce({_LAST}, '') else coalesce({_FIRST}, '') || ' ' || coalesce({_LAST}, '') end"
            ),
            "city": "case c_nationkey % 4 when 0 then 'Oslo' when 1 then 'oslo ' when 2 then 'Rome' end",
        },
    ),
    "dirty_events": (
        "events",
        {
            "event_id": "event_id",
            "event_type": "case when event_id % 3 <> 0 then event_type end",
            "value": "case when event_id % 5 = 0 and event_id > 0 then round(value * 4) / 4.0 end",
            "units": "case when event_id % 4 = 1 then user_id end",
            "note": "case when event_id % 6 = 0 then '' when event_id % 6 <> 1 then 'n' || cast(user_id as string) end",
        },
    ),
    "key_list": (
        "customer",
        {
            "key": (
                f"case c_custkey % 10 when 0 then 'CUST-' || {_K} when 1 then '  CUST-' || {_K} || ' '"
                f" when 2 then 'cust-' || {_K} when 3 then 'CUST-' || {_K} || '-gone' when 4 then '  '"
                " when 5 then null when 6 then 'CUST-7' else 'NOPE' end"
            )
        },
    ),
    "part_keys": ("supplier", {"key": "'ST-' || cast(s_suppkey as string)"}),
    "word_keys": ("benchmark", {"key": "split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)"}),
    "keyed_orders": (
        "orders",
        {
            "o_orderkey": "o_orderkey",
            "cust": (
                "case when o_orderkey % 29 = 0 then null when o_orderkey % 5 = 0 then 'cust-' || cast(o_custkey as string)"
                " else 'CUST-' || cast(o_custkey as string) end"
            ),
            "o_totalprice": "o_totalprice",
            "o_orderpriority": "o_orderpriority",
        },
    ),
    "dirty_part": (
        "part",
        {
            "p_partkey": "p_partkey",
            "label": (
                "case p_partkey % 12 when 0 then null when 1 then '  ' when 2 then 'None' when 3 then 'a/b' when 4 then 'A/B'"
                " when 5 then 'a_b_1' when 6 then '''quoted''' when 7 then ''''''"
                " when 8 then 'a long name that goes on and on ' || p_type"
                " when 9 then 'A LONG NAME THAT GOES ON AND ON ' || p_brand when 10 then p_brand || '/' || p_type"
                " else lower(p_brand) || '*' || p_type end"
            ),
        },
    ),
    "category_orders": (
        "orders",
        {
            "o_orderkey": "o_orderkey",
            "status": (
                "case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then '  '"
                " when o_orderkey % 3 = 0 then lower(o_orderpriority) else o_orderpriority end"
            ),
            "o_custkey": "o_custkey",
        },
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = FIXTURES[name]
    df = table(spark, sf_dir, base)
    for column, expression in PREPARED.get(name, {}).items():
        df = df.selectExpr("*", f"{expression} as {column}")
    return df.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def fixture_sql(*names: str) -> str:
    """The fixtures as common table expressions, to stand before a SELECT."""
    parts = []
    for name in names:
        base, columns = FIXTURES[name]
        for column, expression in PREPARED.get(name, {}).items():
            base = f"(select *, {expression} as {column} from {base})"
        cells = ",\n  ".join(f"{e} as {c}" for c, e in columns.items())
        parts.append(f"{name} as (select\n  {cells}\nfrom {base})")
    return "with " + ",\n".join(parts) + "\n"
