"""Readers and writers: what was written is read back and compared with its source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from registry.fixtures import fixture, fixture_sql, table
from registry.reporting import FILES_SQL, TITLES_SQL
from registry.sqltext import blank, strip
from rowrinse.operators.ordering import ORDER
from rowrinse.session import scratch_path
from rowrinse.sinks.category import read_categories, write_by_category
from rowrinse.sinks.writers import write_segments, write_table
from rowrinse.sources.lookup import lookup_keys, read_lookup
from rowrinse.sources.readers import read_delimited, read_json, read_table

CUSTOMER = fixture_sql("dirty_customer")
ORDERS = fixture_sql("category_orders")
PART = fixture_sql("dirty_part")

_TEXT = ("cust_id", "full_name", "blank_a", "blank_b", "mostly_blank", "email", "amount", "segment")
# empty text comes back from delimited files as null
READ_BACK = f"{CUSTOMER}select {', '.join(f'nullif({c}, {chr(39) * 2}) as {c}' for c in _TEXT)}, cast(nation_key as bigint) as nation_key from dirty_customer"
AS_IS = f"{CUSTOMER}select * from dirty_customer"
FROM_JSON = f"{CUSTOMER}select * replace (cast(nation_key as bigint) as nation_key) from dirty_customer"


def _round_trip(fmt, extension, delimiter=",", read=read_table):
    def run(spark, sf):
        path = scratch_path(spark) + extension
        write_table(fixture(spark, sf, "dirty_customer"), path, fmt, delimiter)
        return read(spark, path)

    return run


def _documents(fmt, extension):
    """Texts with line breaks and quotes."""

    def run(spark, sf):
        path = scratch_path(spark) + extension
        write_table(table(spark, sf, "documents"), path, fmt)
        return read_table(spark, path)

    return run


def _typed(spark, path):
    return read_delimited(spark, path, infer=False)


def _segments(spark, sf):
    path = scratch_path(spark)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    write_segments(rows, path, "parquet", order_by=key, sheet_rows=5_000, segment_rows=5_000)
    return spark.read.parquet(path)


def _one_sheet(spark, sf):
    path = scratch_path(spark)
    write_segments(table(spark, sf, "orders").drop("o_orderdate"), path, "parquet", ["o_totalprice"], order_by=["o_orderkey"])
    return spark.read.parquet(path)


def _sorted(spark, sf):
    path = scratch_path(spark)
    done = write_by_category(
        fixture(spark, sf, "category_orders"), "status", path, "sorted_unified", "parquet",
        ["1-URGENT", "5-low", ""], secondary_sort_column="o_custkey", secondary_sort_descending=True, order_by=["o_orderkey"])
    return spark.read.parquet(done["path"])


def _split(mode, part, **options):
    def run(spark, sf):
        path = scratch_path(spark)
        done = write_by_category(
            fixture(spark, sf, "dirty_part"), "label", path, mode, "parquet", order_by=["p_partkey"], **options)
        if part == "summary":
            return read_delimited(spark, done["summary"], ",")
        names = "file string" if mode == "zip" else "sheet_title string, sheet_no int"
        return read_categories(spark, done["path"], "parquet", f"p_partkey bigint, label string, {names}")

    return run


def _lookup_lines(spark, sf):
    """One messy line of keys per customer."""
    key = F.concat(F.lit("K"), F.col("c_custkey") % 700)
    line = F.concat(
        F.lit(' "'), key, F.lit("\", 'C"), F.col("c_nationkey"), F.lit("' ;;\t"), F.upper("c_mktsegment"), F.lit('\t"" , x y')
    )
    return table(spark, sf, "customer").select(line.alias("value"), F.col("c_custkey").alias(ORDER))


def _lookup_list(spark, sf):
    seen = F.col("first_seen")
    return lookup_keys(_lookup_lines(spark, sf)).select("key", seen["line"].alias("line"), seen["place"].alias("place"))


def _lookup_file(spark, sf):
    path = scratch_path(spark) + ".txt"
    _lookup_lines(spark, sf).select("value").write.text(path)
    return read_lookup(spark, path).select("key")


LOOKUP = (
    "with tokens as (select 'K' || c_custkey % 700 as key, c_custkey as line, 0 as place from customer union all"
    " select 'C' || c_nationkey, c_custkey, 1 from customer union all"
    " select upper(c_mktsegment), c_custkey, 2 from customer union all"
    " select 'x y', c_custkey, 4 from customer)"
)


def _late_text(spark, sf):
    """A code that reads as a number but for its last rows."""
    path = scratch_path(spark) + ".csv"
    late = F.when(F.col("o_orderkey") % 1000 == 999, F.concat(F.lit("A-"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    write_table(table(spark, sf, "orders").select("o_orderkey", late.alias("code")), path, "csv")
    return read_table(spark, path)


def _header_break(spark, sf):
    """A header that spans lines."""
    path = scratch_path(spark) + ".csv"
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("na\ntion"), F.col("n_name").alias("c"))
    write_table(rows, path, "csv")
    out = read_table(spark, path)
    return out.select(F.col("`na\ntion`").alias("nation"), "c")


def _framed(lines, before, between, after):
    """Text files with ``before`` as first line and ``after`` as last; ``between`` follows every line but the last."""

    def frame(batches):
        kept = before
        for batch in batches:
            for line in batch[0].to_pylist():
                if kept is not None:
                    yield pa.RecordBatch.from_pydict({"value": [kept]})
                kept = line + between
        out = [kept.removesuffix(between) if between else kept] + ([after] if after else [])
        yield pa.RecordBatch.from_pydict({"value": out})

    return lines.mapInArrow(frame, "value string")


def _long_ids(spark, sf):
    """Ids of 19 and 20 digits, codes with leading zeros, amounts of many digits.

    Keys beyond 4,775,807 make ids of 19 digits that no bigint holds; these are read as decimal(38, 0).
    """
    path = scratch_path(spark) + ".csv"
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        (F.lit(9223372036850000000).cast("decimal(20,0)") + key).alias("id19"), F.concat(F.lit("1"), F.lpad(key.cast("string"), 19, "0")).alias("id20"),
        F.lpad(key.cast("string"), 9, "0").alias("code"), F.concat(F.lit(9007199254740993) + key, F.lit(".25")).alias("fine"))
    write_table(rows, path, "csv")
    out = read_table(spark, path)
    kinds = dict(out.dtypes)
    return out.select(
        F.col("id19").cast("string").alias("id19"), F.col("id20").cast("string").alias("id20"), "code", F.col("fine").cast("string").alias("fine"),
        *[F.lit(kinds[c]).alias(f"{c}_type") for c in ("id19", "id20", "code", "fine")])


def _reordered(spark, sf):
    """A folder whose files have their columns in other orders, one of them a column more."""
    path = scratch_path(spark)
    rows = table(spark, sf, "orders")
    for k, columns in enumerate((["o_orderkey", "o_orderpriority", "o_custkey"], ["o_custkey", "o_orderkey"], ["o_clerk", "o_orderpriority", "o_orderkey", "o_custkey"])):
        some = rows.withColumn("o_clerk", F.concat(F.lit('clerk "'), "o_custkey", F.lit('"\nof '), "o_orderkey"))
        some.filter(F.col("o_orderkey") % 3 == k).select(*columns).write.mode("append").options(header=True, quote='"', escape='"').csv(path)
    return read_delimited(spark, path, ",").select("o_orderkey", "o_custkey", "o_orderpriority", "o_clerk")


def _header_repair(spark, sf):
    """A header with a nameless column and a name that comes three times."""
    path = scratch_path(spark) + ".csv"
    line = F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('"')), "c_nationkey", "c_mktsegment")
    _framed(table(spark, sf, "customer").select(line), "n,,n,n", "", "").write.text(path)
    return read_table(spark, path)


def _json_array(spark, sf):
    """Files that are one array each, with texts that hold brackets, quotes and backslashes."""
    path = scratch_path(spark) + ".json"
    odd = F.concat(F.lit('}],[{ "\\'), "c_name", F.lit("\n\\\" "))
    record = F.struct("c_custkey", odd.alias("odd"), F.struct("c_nationkey", F.array("c_acctbal").alias("all")).alias("more"))
    _framed(table(spark, sf, "customer").select(F.to_json(record)), "[", ",", "]").write.text(path)
    return read_table(spark, path).select("c_custkey", "odd", F.col("more.c_nationkey").alias("c_nationkey"), F.col("more.all")[0].alias("c_acctbal"))


def _own_sheet(spark, sf):
    """A table with a column of the folders' name."""
    path = scratch_path(spark)
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sheet"))
    write_segments(rows, path, "parquet", order_by=["o_orderkey"])
    return spark.read.parquet(path)


_RAW = f"case when {blank('label')} then 'Blank_Unspecified' else {strip('label')} end"
_SAME = "label is not distinct from n.category"

QUERIES = {
    "scan_parquet": (
        lambda spark, sf: read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice"),
        "select o_orderkey, o_totalprice from orders",
    ),
    "scan_csv": (_round_trip("csv", ".csv"), READ_BACK),
    "scan_text_only": (
        _round_trip("csv", ".csv", read=_typed),
        READ_BACK.replace("cast(nation_key as bigint)", "cast(nation_key as string)"),
    ),
    "scan_sniffed": (_round_trip("csv", ".txt", ";"), READ_BACK),
    "scan_piped": (_round_trip("csv", ".data", "|"), READ_BACK),
    "scan_csv_multiline": (_documents("csv", ".csv"), "select * from documents"),
    "scan_json": (
        _round_trip("json", ".jsonl"),
        FROM_JSON,
    ),
    "scan_csv_long_ids": (
        _long_ids,
        "select cast(9223372036850000000 + o_orderkey as varchar) as id19, '1' || lpad(cast(o_orderkey as varchar), 19, '0') as id20,"
        " lpad(cast(o_orderkey as varchar), 9, '0') as code, cast(9007199254740993 + o_orderkey as varchar) || '.25' as fine,"
        " 'bigint' as id19_type, 'decimal(38,0)' as id20_type, 'string' as code_type, 'decimal(38,2)' as fine_type from orders",
    ),
    "scan_csv_reordered": (
        _reordered,
        "select cast(o_orderkey as bigint) as o_orderkey, cast(o_custkey as bigint) as o_custkey,"
        " case when o_orderkey % 3 <> 1 then o_orderpriority end as o_orderpriority,"
        " case when o_orderkey % 3 = 2 then 'clerk \"' || o_custkey || '\"' || chr(10) || 'of ' || o_orderkey end as o_clerk from orders",
    ),
    "scan_header_repair": (
        _header_repair,
        "select cast(c_custkey as bigint) as n, c_name as col_1, cast(c_nationkey as bigint) as n_duplicated_0, c_mktsegment as n_duplicated_1 from customer",
    ),
    "scan_json_array": (
        _json_array,
        "select cast(c_custkey as bigint) as c_custkey, '}],[{ \"' || chr(92) || c_name || chr(10) || chr(92) || '\" ' as odd,"
        " cast(c_nationkey as bigint) as c_nationkey, c_acctbal from customer",
    ),
    "lookup_list": (
        _lookup_list,
        f"{LOOKUP} select key, line, place from tokens qualify row_number() over (partition by key order by line, place) = 1",
    ),
    "lookup_file": (_lookup_file, f"{LOOKUP} select distinct key from tokens"),
    "scan_csv_late_text": (
        _late_text,
        "select o_orderkey, case when o_orderkey % 1000 = 999 then 'A-' || o_orderkey else cast(o_orderkey as string) end as code from orders",
    ),
    "scan_csv_header_break": (_header_break, "select cast(n_nationkey as bigint) as nation, n_name as c from nation"),
    "export_own_sheet": (_own_sheet, "select o_orderkey, o_orderstatus as sheet, 'Cleaned_Data' as sheet_1 from orders"),
    "export_csv": (_round_trip("csv", ".csv", ";"), READ_BACK),
    "export_tsv": (_round_trip("tsv", ".tsv"), READ_BACK),
    "export_parquet": (_round_trip("parquet", ".parquet"), AS_IS),
    "export_json": (_round_trip("json", ".json", read=read_json), FROM_JSON),
    "export_sheets": (
        _segments,
        "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'Cleaned_Data_Part_' || (cast(floor(("
        "row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) / 5000) as bigint) + 1)"
        " as sheet from lineitem",
    ),
    "export_one_sheet": (_one_sheet, "select * exclude (o_orderdate), 'Cleaned_Data' as sheet from orders"),
    "export_sorted": (
        _sorted,
        f"{ORDERS}select * from category_orders where status in ('1-URGENT', '5-low', '') or {blank('status')}",
    ),
    "export_by_category": (
        _split("zip", "data"),
        f"with n as ({FILES_SQL}) select p.p_partkey, p.label, n.name as file from ({PART}select * from dirty_part) p join n on {_SAME}",
    ),
    "export_by_category_summary": (
        _split("zip", "summary"),
        f'with n as ({FILES_SQL}) select {_RAW} as "Category", n.name || \'.parquet\' as "File", count(*) as "Rows"'
        f" from ({PART}select * from dirty_part) p join n on {_SAME} group by label, n.name",
    ),
    "export_category_sheets": (
        _split("sheets", "data", sheet_rows=50),
        f"with n as ({TITLES_SQL}) select p.p_partkey, p.label, n.name as sheet_title,"
        " cast(floor((row_number() over (partition by p.label order by p.p_partkey) - 1) / 50) as int) + 1 as sheet_no"
        f" from ({PART}select * from dirty_part) p join n on {_SAME}",
    ),
    "export_category_overview": (
        _split("sheets", "summary"),
        f"{PART}select case when {blank('label')} then '(Blank / Unspecified)' else {strip('label')} end as category,"
        " count(*) as total_records, count(*) / (select count(*) from dirty_part) as share from dirty_part group by label"
        " union all select 'TOTAL', count(*), 1.0 from dirty_part",
    ),
}
