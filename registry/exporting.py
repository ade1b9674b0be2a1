"""Requests that are cleaned and then written, and column roles that decide a result."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from registry.fixtures import fixture, fixture_sql, table
from registry.sqltext import blank, strip
from registry.whole import FULL, FULL_SQL, PEOPLE
from rowrinse.operators.dedupe import dedupe
from rowrinse.operators.match import match_keys
from rowrinse.operators.ordering import in_blocks, sort_keys, with_order, with_row_index
from rowrinse.operators.roles import category_column, category_kind, dedupe_preset, key_column, secondary_sort_column
from rowrinse.operators.summary import category_counts, category_summary, source_size
from rowrinse.plans.export import clean_and_export, clean_and_split
from rowrinse.session import scratch_path
from rowrinse.sinks.category import read_categories, write_by_category
from rowrinse.sinks.writers import write_table
from rowrinse.sources.readers import read_table

PEOPLE_TABLE = fixture_sql("dirty_people")
PART = fixture_sql("dirty_part")


def _exported(fmt, extension):
    """Clean, write, read back, with what the export says of itself."""

    def run(spark, sf):
        done = clean_and_export(
            fixture(spark, sf, "dirty_customer"), FULL, scratch_path(spark) + extension, fmt,
            order_by=["cust_id"], match_list=fixture(spark, sf, "key_list"))
        out = read_table(spark, done["path"])
        right = source_size(out).first()[0] == done["size_bytes"] > 0
        return out.withColumns({"told_rows": F.lit(done["rows"]).cast("bigint"), "told_cols": F.lit(done["cols"]), "size_is_right": F.lit(right)})

    return run


def _split(mode, names, schema):
    def run(spark, sf):
        done = clean_and_split(fixture(spark, sf, "dirty_people"), PEOPLE, scratch_path(spark), None, mode, "parquet", order_by=["person_id"])
        rows = read_categories(spark, done["path"], "parquet", f"person_id bigint, city string, {schema}")
        return rows.select("person_id", "city", *names, F.lit(done["split_column"]).alias("split_column"), F.lit(done["rows"]).cast("bigint").alias("told_rows"))

    return run


def _kept_people():
    return (
        f"{PEOPLE_TABLE}, p as (select {strip('city')} as city, {strip('full_name')} as n, person_id from dirty_people),"
        " q as (select person_id, upper(city[1]) || lower(city[2:]) as city from p qualify row_number() over"
        " (partition by lower(n) order by person_id) = 1)"
    )


def _kind(spark, sf):
    """Each table split by the column a reader would choose: its overview and what kind of column that is."""
    out = None
    for name in ("customer", "orders", "supplier", "documents"):
        df = table(spark, sf, name)
        column = category_column(df.columns)
        one = category_summary(category_counts(df, column)).select(
            F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit(category_kind(column)).alias("kind"), "category", "total_records")
        out = one if out is None else out.unionByName(one)
    return out


def _kinds_sql():
    parts = []
    for name, column, kind in (("customer", "c_nationkey", "Geographic"), ("orders", "o_orderstatus", "Category"),
                               ("supplier", "s_nationkey", "Geographic"), ("documents", "doc_id", None)):
        head = f"select '{name}' as \"table\", '{column}' as \"column\", {repr(kind) if kind else 'cast(null as varchar)'} as kind"
        parts.append(f"{head}, cast({column} as varchar) as category, count(*) as total_records from {name} group by {column}")
        parts.append(f"{head}, 'TOTAL', count(*) from {name}")
    return " union all ".join(parts)


def _by_default_key(spark, sf):
    """A key list matched against the column that looks like a key."""
    df = fixture(spark, sf, "dirty_customer").select("full_name", "amount", "email", "cust_id")
    keys = table(spark, sf, "customer").filter("c_custkey % 7 = 3").select(F.concat(F.lit(" User"), "c_custkey", F.lit("@example.COM")).alias("k"))
    return match_keys(df, key_column(df.columns), keys, how="case_insensitive")


def _sorted_by_roles(spark, sf):
    """Rows numbered in the order of the chosen category and the chosen second column, then as given."""
    df = with_order(fixture(spark, sf, "dirty_people"), ["person_id"])
    columns = ["person_id", "city", "first_name", "full_name"]
    names = [c.replace("_", " ") for c in columns]
    df = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], "__row_order")
    keys = sort_keys(df, [category_column(names), secondary_sort_column(names)], [False, True])
    placed = with_row_index(in_blocks(df, *keys), "position")
    return placed.select(F.col("person id").alias("person_id"), "position")


def _preset(preset):
    def run(spark, sf):
        df = fixture(spark, sf, "dirty_people").select(
            F.col("person_id").alias("Id"), F.col("first_name").alias("First Name"), F.col("last_name").alias("Last Name"), F.col("city").alias("City"))
        keys = dedupe_preset(df.columns, preset)
        out = dedupe(df, "custom" if keys else "all_columns", keys, order_by=["Id"])
        return out.select(F.col("Id").alias("person_id"))

    return run


def _preset_sql(*keys):
    if not keys:
        return f"{PEOPLE_TABLE}select person_id from dirty_people"
    by = ", ".join(f"lower({strip(k)})" for k in keys)
    return f"{PEOPLE_TABLE}select person_id from dirty_people qualify row_number() over (partition by {by} order by person_id) = 1"


def _safe_folder(spark, sf):
    """The folder of a split is named after its column, made safe."""
    df = fixture(spark, sf, "dirty_part").withColumnRenamed("label", "Part label/№ 1")
    done = write_by_category(df, "Part label/№ 1", scratch_path(spark), "sorted_unified", "parquet", order_by=["p_partkey"])
    out = spark.read.parquet(done["path"])
    return out.select("p_partkey", F.col("`Part label/№ 1`").alias("label"), F.lit(os.path.basename(done["path"])).alias("folder"))


def _refusals(spark, sf):
    """What is said where a table cannot be written, and the rows of the table that stay unwritten."""
    df = fixture(spark, sf, "dirty_part")
    path = scratch_path(spark)
    by = {"order_by": ["p_partkey"]}
    tries = {
        "unknown format": lambda: write_table(df, path, "xlsx"),
        "no such column": lambda: write_by_category(df, "colour", path, **by),
        "nothing left": lambda: write_by_category(df, "label", path, selected_categories=["no such label"], **by),
        "unknown mode": lambda: write_by_category(df, "label", path, "pages", **by),
        "no order": lambda: write_by_category(df.groupBy("label").count(), "label", path),
    }
    out = None
    for case, attempt in tries.items():
        try:
            attempt()
            said = None
        except ValueError as error:
            said = str(error)
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(case).alias("case"), F.lit(said).alias("said"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


SAID = {
    "unknown format": "unknown format 'xlsx'; formats: csv, tsv, parquet, json",
    "no such column": "no category column 'colour'",
    "nothing left": "no rows are left for the chosen categories",
    "unknown mode": "unknown export mode 'pages'; modes: sorted_unified, zip, sheets",
    "no order": "the rows of this table have no order of their own: name the columns that give it in order_by",
}
_TOLD = "(select count(*) from kept) as told_rows, 6 as told_cols, true as size_is_right"
_ROWS = "select \"Customer\", full_name, coalesce(email, '(none)') as email, amount, \"Market\", nation_key"
_FROM_TEXT = "select \"Customer\", full_name, coalesce(email, '(none)') as email, amount, \"Market\", cast(nation_key as bigint) as nation_key"

QUERIES = {
    "export_cleaned": (_exported("parquet", ".parquet"), f"{FULL_SQL} {_ROWS}, {_TOLD} from kept"),
    # empty text comes back from delimited files as null
    "export_cleaned_csv": (_exported("csv", ".csv"), f"{FULL_SQL} {_FROM_TEXT.replace("coalesce(email, '(none)')", "nullif(coalesce(email, '(none)'), '')")}, {_TOLD} from kept"),
    "export_cleaned_json": (
        _exported("json", ".json"), f"{FULL_SQL} {_FROM_TEXT}, {_TOLD} from kept"),
    "split_cleaned": (
        _split("zip", ["file"], "file string"),
        f"{_kept_people()} select person_id, city, coalesce(city, 'Blank_Unspecified') as file, 'city' as split_column,"
        " (select count(*) from q) as told_rows from q",
    ),
    "split_cleaned_sheets": (
        _split("sheets", ["sheet_title", "sheet_no"], "sheet_title string, sheet_no int"),
        f"{_kept_people()} select person_id, city, coalesce(city, 'Blank_Unspecified') as sheet_title, 1 as sheet_no, 'city' as split_column,"
        " (select count(*) from q) as told_rows from q",
    ),
    "category_kind": (_kind, _kinds_sql()),
    "extract_default_key": (
        _by_default_key,
        f"{fixture_sql('dirty_customer')}select full_name, amount, email, cust_id from dirty_customer where lower(email) in"
        " (select 'user' || c_custkey || '@example.com' from customer where c_custkey % 7 = 3)",
    ),
    "sort_by_roles": (
        _sorted_by_roles,
        f"{PEOPLE_TABLE}select person_id, row_number() over (order by city nulls last, first_name desc nulls last, person_id) - 1 as position from dirty_people",
    ),
    "dedupe_preset_people": (_preset("people"), _preset_sql("first_name", "last_name")),
    "dedupe_preset_first_name": (_preset("first_name"), _preset_sql("first_name")),
    "dedupe_preset_all": (_preset("all"), _preset_sql()),
    "export_safe_folder": (_safe_folder, f"{PART}select p_partkey, label, 'sorted_by_Part_label___1' as folder from dirty_part"),
    "export_refusals": (
        _refusals,
        " union all ".join(
            f"select '{case}' as \"case\", '{said.replace(chr(39), chr(39) * 2)}' as said, count(*) as rows from part" for case, said in SAID.items()),
    ),
}
