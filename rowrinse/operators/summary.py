"""Counts per table, per column and per value."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.labels import TOTAL_LABEL, blank_label, raw_category
from rowrinse.functions.text import amount, blank, col, is_text, strip
from rowrinse.operators.ordering import ORDER, data_columns, with_order
from rowrinse.operators.roles import looks_like_money
from rowrinse.session import stage

# Sizes of the samples and reports.
SAMPLE_VALUES = 4
NUMERIC_SHARE = 0.6

# Up to here each column is counted in a branch of its own.
BRANCH_COLUMNS = 64
# Rows looked at for each value wanted, before a column is searched on its own.
HEAD_FACTOR = 5

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _value_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text such that equal values give equal text."""
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, _NESTED):
        return F.to_json(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0).cast(dtype)).cast("string")  # one zero, not two
    return c.cast("string")


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_cols", F.lit(len(data_columns(df))))


def column_statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """Blank cells and distinct values of every column.

    Null counts as one distinct value. The exact form counts values, which
    combine before the shuffle and spread over the values: one branch per
    column, so that each reads its own column only and values keep their type,
    or one unpivoted pass for a wide table. The approximate form keeps a sketch
    per column and shuffles no values.
    """
    names, types = data_columns(df), _types(df)
    known = df.sparkSession.createDataFrame(
        pa.table(
            {
                "position": pa.array(range(len(names)), pa.int32()),
                "column": pa.array(names, pa.string()),
                "dtype": pa.array([types[c].simpleString() for c in names], pa.string()),
            }
        )
    )
    if exact and len(names) <= BRANCH_COLUMNS:
        counted = _by_branch(df, names, types)
    elif exact:
        counted = _by_unpivot(df, names, types)
    else:
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(names):
            value = col(c) if not isinstance(types[c], _NESTED) else F.to_json(col(c))
            aggregates.append(
                F.struct(
                    F.lit(i).alias("__position"),
                    F.count_if(blank(col(c), types[c])).alias("blank_count"),
                    (F.approx_count_distinct(value) + F.max(value.isNull().cast("int"))).alias("distinct_count"),
                ).alias(f"s{i}")
            )
        counted = (
            df.agg(*aggregates)
            .select("rows", F.inline(F.array(*[f"s{i}" for i in range(len(names))])))
            .filter(F.col("rows") > 0)
        )
    share = F.round(100.0 * F.col("blank_count") / F.col("rows"), 2)
    return known.join(counted, known["position"] == counted["__position"], "left").select(
        "position",
        "column",
        "dtype",
        F.coalesce("blank_count", F.lit(0)).cast("bigint").alias("blank_count"),
        F.coalesce(share, F.lit(0.0)).alias("blank_pct"),
        F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"),
        F.coalesce(F.col("blank_count") == F.col("rows"), F.lit(False)).alias("is_blank"),
    )


def _by_branch(df: DataFrame, names: Sequence[str], types: dict[str, T.DataType]) -> DataFrame:
    """Counts per column from one grouping per column."""
    parts = []
    for i, c in enumerate(names):
        key = F.to_json(col(c)) if isinstance(types[c], T.MapType) else col(c)
        values = df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            values.agg(
                F.lit(i).alias("__position"),
                F.sum("n").alias("rows"),
                F.sum(F.when(blank(F.col("value"), types[c]), F.col("n")).otherwise(0)).alias("blank_count"),
                F.count(F.lit(1)).alias("distinct_count"),
            )
        )
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    """All parts in one, joined in pairs: a chain is analysed again with every link."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionAll(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]


def _by_unpivot(df: DataFrame, names: Sequence[str], types: dict[str, T.DataType]) -> DataFrame:
    """Counts per column from one grouping of (column, value, blank) triples; blank is judged on the typed value."""
    cells = df.select(*[
        F.struct(_cell_text(col(c), types[c]).alias("value"), blank(col(c), types[c]).alias("blank")).alias(str(i))
        for i, c in enumerate(names)
    ])
    values = cells.unpivot([], [col(str(i)) for i in range(len(names))], "__position", "cell")
    return (
        values.groupBy("__position", F.col("cell.value").alias("value"), F.col("cell.blank").alias("blank"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("__position").cast("int").alias("__position"))
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank_count"),
            F.count(F.lit(1)).alias("distinct_count"),
        )
    )


def _cell_text(c: Column, dtype: T.DataType) -> Column:
    """As :func:`_value_text`, but equal for equal values only: instants and nested values with all their parts."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return _value_text(c, dtype)


def text_statistics(df: DataFrame) -> DataFrame:
    """The short profile: blank cells, blank share to one place and distinct values, every type as text."""
    stats = column_statistics(df.select(*[col(c) for c in data_columns(df)]))
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    pct = F.round(100.0 * F.col("blank_count") / rows.scalar(), 1)
    return stats.select(
        "column",
        F.lit("String").alias("dtype"),
        "blank_count",
        F.coalesce(pct, F.lit(0.0)).alias("blank_pct"),
        "distinct_count",
        "is_blank",
    )


def row_digest(df: DataFrame) -> list[Column]:
    """Two longs that equal rows share and other rows do not, but for a chance of one in 2^128 a pair.

    A null leaves a hash as it is, so the places of the nulls are hashed too;
    nested values are hashed as JSON text, which shows the nulls inside.
    """
    types = _types(df)
    nested = (T.ArrayType, T.MapType, T.StructType)
    names = data_columns(df)
    cells = [F.to_json(col(c), {"ignoreNullFields": "false"}) if isinstance(types[c], nested) else col(c) for c in names]
    nulls = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in names]) if names else F.lit("")
    return [F.xxhash64(F.lit(seed), nulls, *cells).alias(f"digest_{seed}") for seed in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows belong to a group of equal rows, every member counted; only digests are shuffled."""
    groups = df.groupBy(*row_digest(df)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def first_values(
    df: DataFrame, columns: Sequence[str], n: int, wanted: Callable[[Column, T.DataType], Column]
) -> DataFrame:
    """The first ``n`` wanted values of each column in row order: (position, column, __at, value).

    The head of the table mostly has them all. A column that it does not serve
    gets a top-k of its own, which reads that column alone. Needs ``ORDER``.
    """
    types = _types(df)
    size = n * HEAD_FACTOR
    head = stage(
        df.select(
            F.col(ORDER).alias("__at"),
            *[
                F.when(wanted(col(c), types[c]), _value_text(col(c), types[c])).alias(str(i))
                for i, c in enumerate(columns)
            ],
        )
        .orderBy("__at")
        .limit(size)
    )
    positions = [str(i) for i in range(len(columns))]
    held = head.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(i)).alias(i) for i in positions]).first()
    served = [i for i in positions if held[i] >= n or held["rows"] < size]
    named = F.create_map(*[F.lit(x) for pair in enumerate(columns) for x in pair])
    parts = []
    if served:
        place = Window.partitionBy("position").orderBy("__at")
        parts.append(
            head.unpivot(["__at"], [col(i) for i in served], "position", "value")
            .filter(F.col("value").isNotNull())
            .withColumn("place", F.row_number().over(place))
            .filter(F.col("place") <= n)
            .select(F.col("position").cast("int").alias("position"), "__at", "value")
        )
    for i in positions:
        if i not in served:
            c = columns[int(i)]
            top = df.filter(wanted(col(c), types[c])).orderBy(ORDER).limit(n)
            parts.append(
                top.select(
                    F.lit(int(i)).alias("position"), F.col(ORDER).alias("__at"), _value_text(col(c), types[c]).alias("value")
                )
            )
    return _union(parts).select("position", F.element_at(named, F.col("position")).alias("column"), "__at", "value")


def sample_values(df: DataFrame, n: int = SAMPLE_VALUES, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` non-blank values of every column as text, in row order."""
    ordered = with_order(df, order_by)
    found = first_values(ordered, data_columns(df), n, lambda c, t: ~blank(c, t))
    return found.groupBy("position", "column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__at", "value"))), lambda s: s["value"]).alias("samples")
    )


def numeric_likeness(df: DataFrame) -> DataFrame:
    """How far each text column looks like amounts, by all its non-null values, in one aggregate.

    A column is a candidate where enough of them read as a number, or where
    its name speaks of money and all of them do that are not blank.
    """
    names = [c for c in data_columns(df) if is_text(_types(df)[c])]
    empty = "column string, sampled bigint, numeric bigint, numeric_share double, candidate boolean"
    if not names:
        return df.sparkSession.createDataFrame([], empty)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.count(col(c)).alias("sampled"), F.count_if(amount(col(c)).isNotNull()).alias("numeric"),
            F.count_if(~blank(col(c), T.StringType())).alias("__filled"), F.lit(looks_like_money(c)).alias("__money"))
        for c in names
    ]
    found = df.agg(F.array(*cells).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*").filter("sampled > 0")
    share = F.col("numeric") / F.col("sampled")
    every = (F.col("numeric") > 0) & (F.col("numeric") == F.col("__filled"))
    return found.select(
        "column", "sampled", "numeric", share.alias("numeric_share"),
        ((share >= NUMERIC_SHARE) | (F.col("__money") & every)).alias("candidate"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """The values by frequency, all or the first ``limit``; the label is trimmed after counting, ties go by value."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "value string, display string, count bigint")
    text = F.col("__v").cast("string")
    is_blank = blank(text, T.StringType())
    counted = (
        df.groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("__v"))
    )
    return (
        (counted if limit is None else counted.limit(limit))
        .select(F.when(is_blank, "").otherwise(strip(text)).alias("value"), blank_label(F.col("__v")).alias("display"), "count")
    )


def distinct_total(df: DataFrame, column: str) -> DataFrame:
    """How many distinct values a column has, null counted as one; 0 for an unknown column."""
    if column not in df.columns:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("total_unique"))
    return df.groupBy(col(column)).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("total_unique"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, as (category, rows)."""
    return df.groupBy(col(column).alias("category")).agg(F.count(F.lit(1)).alias("rows"))


def category_summary(counts: DataFrame) -> DataFrame:
    """The overview of :func:`category_counts`: label, rows, share, largest first, then the total.

    The total comes from a rollup over the counts, so it can be told apart from
    a category that is null.
    """
    total = counts.agg(F.sum("rows"))
    is_total = F.grouping("category") == 1
    rolled = counts.rollup("category").agg(F.sum("rows").alias("total_records"), is_total.alias("is_total"))
    return (
        rolled.filter(F.col("total_records").isNotNull())
        .select(
            F.when(F.col("is_total"), TOTAL_LABEL).otherwise(blank_label(F.col("category"))).alias("category"),
            "total_records",
            (F.col("total_records") / total.scalar()).alias("share"),
            "is_total",
        )
        .orderBy("is_total", F.desc("total_records"), "category")
    )


def file_summary(named: DataFrame) -> DataFrame:
    """The overview of a split into files: category, file, rows; takes (category, rows, file)."""
    return named.select(
        raw_category(F.col("category")).alias("Category"), F.col("file").alias("File"), F.col("rows").alias("Rows")
    )


def before_after(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows and columns of two tables and what went between them, as one row."""
    before, after = F.col("rows_before"), F.col("rows_after")
    counts = raw.agg(F.count(F.lit(1)).alias("rows_before")).withColumn(
        "rows_after", cleaned.agg(F.count(F.lit(1))).scalar()
    )
    kept = data_columns(cleaned)
    return counts.select(
        before,
        F.lit(len(data_columns(raw))).alias("cols_before"),
        after,
        F.lit(len(kept)).alias("cols_after"),
        (before - after).alias("removed_rows"),
        F.lit(len(data_columns(raw)) - len(kept)).alias("removed_cols"),
        F.when(before > 0, F.round(100.0 * (before - after) / before, 1)).otherwise(0.0).alias("row_change_pct"),
        F.array(*[F.lit(c) for c in kept]).alias("columns"),
    )


def source_size(df: DataFrame) -> DataFrame:
    """Bytes of the files a table was read from, by their listing; no row is read. 0 where it was not read from files."""
    return files_size(df.sparkSession, [urllib.parse.unquote(f) for f in df.inputFiles()])


def files_size(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Bytes of files, or of all files of folders."""
    if not paths:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("size_bytes"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("length")
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
