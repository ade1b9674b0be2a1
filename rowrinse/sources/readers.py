"""Reading delimited, JSON and Parquet tables."""

from __future__ import annotations

import csv
import functools
import io
import os
import urllib.parse
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.text import parse_number
from rowrinse.operators.ordering import ORDER, with_order
from rowrinse.session import scratch_path
from rowrinse.sources.records import JsonArray, QuotedLines, ranged, records, runs_of

# Separators to try, name of a missing header.
SEPARATORS = (",", ";", "\t", "|")
MISSING_HEADER = "col_{}"

_SNIFF_LINES = 50
# What a cell reads as; a column's cells are summed up by the bits of all their kinds.
SHORT, LONG, BIG, FRACTION, EXACT, SCIENTIFIC, BOOLEAN, DATE, TIME, TEXT = (1 << k for k in range(10))
_INTEGER = r"^[+-]?\d{1,38}$"
_TYPED = r"^[-+.\dtTfFiN]"  # how any cell begins that is not text
_LEADING_ZERO = r"^[+-]?0\d"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)$"
_SCIENTIFIC = r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$|^[+-]?(inf|NaN)$"
_BOOLEAN = r"^(?i:true|false)$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"


def read_table(spark: SparkSession, path: str, keep_order: bool = False) -> DataFrame:
    """Read by file extension; an unknown one is taken as delimited text."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        df = spark.read.parquet(path)
        return with_order(df) if keep_order else df
    if kind in (".json", ".jsonl", ".ndjson"):
        df = read_json(spark, path, keep_order=keep_order)
        return with_order(df) if keep_order else df
    if kind in (".xlsx", ".xls"):
        raise ValueError("spreadsheet files are not read; save the sheet as CSV or Parquet")
    return read_delimited(spark, path, "\t" if kind == ".tsv" else None, keep_order=keep_order)


def first_lines(spark: SparkSession, path: str, n: int = _SNIFF_LINES) -> list[str]:
    """The first lines of a file; stops as soon as it has them."""
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0).select("value").take(n)
    return [r[0].removeprefix("﻿") for r in lines]


def sniff_separator(lines: Sequence[str], default: str = ",") -> str:
    """The separator that cuts most lines into as many fields as the first one."""

    def steadiness(sep: str) -> tuple[int, int]:
        widths = [len(row) for row in csv.reader(lines, delimiter=sep) if row]
        if not widths or widths[0] < 2:
            return 0, 0
        return sum(w == widths[0] for w in widths), widths[0]

    candidates = [default, *[s for s in SEPARATORS if s != default]]
    best = max(candidates, key=steadiness)
    return best if steadiness(best)[0] else default


def repair_header(names: Sequence[str | None]) -> list[str]:
    """Name the nameless columns by position and number the repeats."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = name if name else MISSING_HEADER.format(i)
        copies = 0
        unique = name
        while unique in out:
            unique = f"{name}_duplicated_{copies}"
            copies += 1
        out.append(unique)
    return out


def has_quoted_breaks(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether any line holds an odd number of quotes, so that a record may span lines."""
    return not spark.read.text(path).filter(_odd_quotes(F.col("value"))).limit(1).isEmpty()


def _odd_quotes(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def kind_of(cell: str) -> str:
    """SQL for the kind of a cell as one bit, null for a null cell."""
    is_ = lambda pattern: f"{cell} rlike r'{pattern}'"
    digits = f"length(translate({cell}, '+-.', ''))"
    date, time = f"{is_(_DATE)} and try_cast({cell} as date) is not null", f"{is_(_TIME)} and try_cast({cell} as timestamp_ntz) is not null"
    return f"""case when {cell} is null then null
        when not ({is_(_TYPED)}) then {TEXT}
        when {is_(_LEADING_ZERO)} then case when {date} then {DATE} when {time} then {TIME} else {TEXT} end
        when {is_(_INTEGER)} then case
            when {digits} <= 15 then {SHORT} when {digits} <= 19 and try_cast({cell} as bigint) is not null then {LONG} else {BIG} end
        when {is_(_DECIMAL)} then -- exact as a double where the double is written as it is
            case when {digits} <= 15 or cast(try_cast({cell} as double) as string) = {cell} then {FRACTION} else {EXACT} end
        when {is_(_SCIENTIFIC)} then {SCIENTIFIC}
        when {is_(_BOOLEAN)} then {BOOLEAN}
        when {date} then {DATE}
        when {time} then {TIME}
        else {TEXT} end"""


def kinds_of(df: DataFrame, cells: Sequence[str], *more: Column) -> DataFrame:
    """One row: for each column the bits of its kinds and the most digits before the point and after it, and ``more``."""
    out = []
    for i, cell in enumerate(cells):
        plain = f"__k{i} & {SHORT | LONG | BIG | FRACTION | EXACT} <> 0"
        out += [
            f"bit_or(__k{i}) as k{i}",
            f"max(case when {plain} then length(translate(substring_index({cell}, '.', 1), '+-', '')) end) as w{i}",
            f"max(case when {plain} and contains({cell}, '.') then length(substring_index({cell}, '.', -1)) end) as f{i}"]
    return df.selectExpr("*", *[f"{kind_of(c)} as __k{i}" for i, c in enumerate(cells)]).agg(*map(F.expr, out), *more)


def type_of(kinds: int, whole: int, after: int, dates: bool = False) -> T.DataType:
    """The narrowest type that holds all cells of these kinds as they are written.

    bigint, decimal(38, 0) and double for numbers, a decimal where digits would
    be lost in a double, text where no type holds them all. Numbers with
    leading zeros are text. Dates stay text unless ``dates``.
    """
    if not kinds or kinds & TEXT:
        return T.StringType()
    if kinds == BOOLEAN:
        return T.BooleanType()
    if dates and not kinds & ~(DATE | TIME):
        return T.DateType() if kinds == DATE else T.TimestampNTZType()
    if kinds & (BOOLEAN | DATE | TIME):
        return T.StringType()
    if not kinds & ~(SHORT | LONG):
        return T.LongType()
    if not kinds & ~(SHORT | LONG | BIG):
        return T.DecimalType(38, 0)
    if not kinds & (LONG | BIG | EXACT):
        return T.DoubleType()
    if kinds & SCIENTIFIC or whole + after > 38:
        return T.StringType()
    return T.DecimalType(38, after)


class _Part:
    """The files that share a header line: their names, and the columns as text under positional names."""

    def __init__(self, paths: str | list[str], header: str, names: list[str]):
        self.paths, self.header, self.names = paths, header, names
        self.cells = [f"c{i}" for i in range(len(names))]


def _headers(spark: SparkSession, files: list[str], sep: str) -> dict[str, list[str]]:
    """The first record of each file, and the files that begin with it; a record may span lines."""
    first = ranged(spark, files, "\n").filter(F.col("start") == 0)
    kind = QuotedLines(sep)

    def heads(batches):
        file, lines, state = None, [], 1
        for batch in batches:
            for at, end in runs_of(batch):
                here = batch["file"][at].as_py()
                if here != file:
                    if lines:
                        yield pa.RecordBatch.from_pydict({"file": [file], "header": ["\n".join(lines)]})
                    file, lines, state = here, [], -1
                # only the lines of the header are looked at
                while state and at < end:
                    lines.append(batch["value"][at].as_py())
                    state, _ = kind.after(max(state, 0), lines[-1])
                    at += 1
        if lines:
            yield pa.RecordBatch.from_pydict({"file": [file], "header": ["\n".join(lines)]})

    out: dict[str, list[str]] = {}
    for r in first.mapInArrow(heads, "file string, header string").orderBy("file").collect():  # a row per file, as Spark lists them anyway
        out.setdefault(r["header"].removeprefix("\ufeff").removesuffix("\r"), []).append(urllib.parse.unquote(r["file"]))
    return out


def _fields(line: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(line + "\n"), delimiter=sep))


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    infer: bool = True,
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
    keep_order: bool = False,
    dates: bool = False,
) -> DataFrame:
    """Read delimited text with a header line.

    Without ``sep`` it is found from the first lines. Types are judged by all
    cells (:func:`type_of`), so none is lost; surplus fields are cut and short
    rows filled up. In a folder the columns are those of the files' own
    headers, united by name; a file without a column has nulls there.

    The header is a record and may span lines. ``multi_line=None`` looks for
    records that span lines in the pass that judges the types. Files with such
    records are cut into records in parallel (:mod:`rowrinse.sources.records`);
    ``multi_line=False`` says that there are none. ``schema`` skips the header,
    the types and their reading; all files then have its columns in order.
    """
    lines = first_lines(spark, path)
    if not lines:
        raise ValueError(f"no header line in {path}")
    sep = sep or sniff_separator(lines)
    files = spark.read.text(path).inputFiles()
    if schema:
        parts = [_Part(path, "", list(schema.names))]
    elif len(files) == 1:
        names = next(csv.reader(io.StringIO("\n".join(lines) + "\n"), delimiter=sep))
        parts = [_Part(path, lines[0], repair_header(names))]
    else:
        heads = _headers(spark, path, sep)
        parts = [_Part(path if len(heads) == 1 else found, head, repair_header(_fields(head, sep))) for head, found in heads.items()]
    names = list(dict.fromkeys(n for p in parts for n in p.names))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    judge = infer and not schema

    def parsed(text: Column, part: _Part) -> Column:
        return F.from_csv(text, ", ".join(f"{c} string" for c in part.cells), options)

    seen: dict[str, list[int]] = {n: [0, 0, 0] for n in names}
    broken = bool(multi_line)
    if multi_line is None and not judge:
        broken = has_quoted_breaks(spark, path)
    if judge and not broken:
        for part in parts:
            # a header line is no cell; one that comes again as a row has the same kinds as text
            rows = spark.read.text(part.paths).filter(~F.col("value").isin(part.header, "\ufeff" + part.header) & (F.trim("value") != ""))
            rows = rows.select("value", parsed(F.col("value"), part).alias("r"))
            asked = [F.max(_odd_quotes(F.col("value"))).alias("odd")] if multi_line is None else []
            broken |= _judge(rows, [f"r.{c}" for c in part.cells], part.names, seen, asked)
    frames = []
    if broken:
        seen = {n: [0, 0, 0] for n in names}
        for part in parts:
            found = records(spark, part.paths, QuotedLines(sep)).filter((F.col("start") != 0) | (F.col("seq") != 0))
            found = found.withColumn("text", F.regexp_replace("text", r"\r$", "")).filter(F.trim("text") != "")
            df = found.select("file", "start", "seq", parsed(F.col("text"), part).alias("r"))
            if judge:
                _judge(df, [f"r.{c}" for c in part.cells], part.names, seen, [])
            order = F.struct("file", F.col("start").alias("split"), F.col("seq").alias("line")).alias(ORDER)
            frames.append(df.select(*[F.col(f"r.{c}").alias(c) for c in part.cells], *([order] if keep_order else [])))
    else:
        for part in parts:
            text = T.StructType([T.StructField(c, T.StringType()) for c in part.cells])
            df = spark.read.options(header=True, **options).schema(text).csv(part.paths)
            frames.append(with_order(df) if keep_order else df)
    types = {f.name: f.dataType for f in schema.fields} if schema else {n: type_of(*seen[n], dates) for n in names}
    typed = [
        df.select(*[_typed(F.col(part.cells[part.names.index(n)]) if n in part.names else F.lit(None), types[n]).alias(n) for n in names], *df.columns[len(part.names) :])
        for df, part in zip(frames, parts)
    ]
    return functools.reduce(DataFrame.unionByName, typed)


def _judge(df: DataFrame, cells: list[str], names: list[str], seen: dict[str, list[int]], asked: list[Column]) -> bool:
    """Add what the cells of ``df`` are to ``seen``, in one aggregate; returns the first of what else is asked."""
    row = kinds_of(df, cells, *asked).first()
    for i, name in enumerate(names):
        seen[name][0] |= row[f"k{i}"] or 0
        seen[name][1] = max(seen[name][1], row[f"w{i}"] or 0)
        seen[name][2] = max(seen[name][2], row[f"f{i}"] or 0)
    return bool(asked and row[-1])


def _typed(cell: Column, kind: T.DataType) -> Column:
    return parse_number(cell.cast("string")) if isinstance(kind, T.DoubleType) else cell.try_cast(kind)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, keep_order: bool = False) -> DataFrame:
    """Read JSON arrays of records, or one record per line.

    An array is cut into its records in parallel, which are written once, a
    record per line, to the scratch folder. A file that begins with ``[`` and
    holds anything but records is an error.
    """
    start = "".join(first_lines(spark, path)).lstrip()
    if start.startswith("["):
        found = records(spark, path, JsonArray())
        found = found.orderBy("file", "start", "seq") if keep_order else found
        path = scratch_path(spark)
        # line breaks in a record only stand between its parts
        found.select(F.translate("text", "\r\n", "  ").alias("value")).write.text(path)
    return (spark.read.schema(schema) if schema else spark.read).json(path)
