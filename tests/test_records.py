from __future__ import annotations

import csv
import io
import itertools
import json
import random
from decimal import Decimal

import pytest

from rowrinse.sources import readers
from rowrinse.sources.records import JsonArray, QuotedLines, ranged, records


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 300 bytes, so that most records cross one."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


CELLS = ["", "a", "b c", 'say ""x""', "two\nlines", "\n\n", ",", 'end"', "é" * 30, "line\n" * 40, "1", '"', '""', "x,y\nz"]


def table(seed, rows=60):
    rng = random.Random(seed)
    return [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(rows)]


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_quoted_breaks_in_many_ranges(spark, tmp_path, small_ranges, seed, end):
    rows = table(seed)
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "p\nq", "r"], *rows])
    path = put(tmp_path, "t.csv", out.getvalue())
    assert ranged(spark, path, "\n").rdd.getNumPartitions() >= 5
    df = readers.read_delimited(spark, path, infer=False, keep_order=True)
    assert df.columns == ["id", "p\nq", "r", "__row_order"]
    got = [list(r)[:3] for r in df.orderBy("__row_order").collect()]
    assert got == [[c or None for c in r] for r in rows]


def test_a_stray_quote_is_a_character(spark, tmp_path, small_ranges):
    text = "a,b\n" + "".join(f'{i},5" pipe\n' for i in range(50)) + '50,"two\nlines"\n'
    df = readers.read_table(spark, put(tmp_path, "t.csv", text))
    assert df.count() == 51 and df.filter('b = \'5" pipe\'').count() == 50
    assert df.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("sep", [",", ";;"])
def test_states_combine_as_one_pass(sep):
    kind, rng = QuotedLines(sep), random.Random(5)
    lines = ["".join(rng.choice(['"', sep, "a", '""', f'{sep}"']) for _ in range(rng.randrange(8))) for _ in range(300)]
    whole = list(itertools.accumulate(lines, lambda s, x: kind.after(s, x)[0], initial=0))
    for cut in (1, 40, 299):
        ends = [0, 1]
        for line in lines[cut:]:
            ends = [kind.after(e, line)[0] for e in ends]
        assert ends[whole[cut]] == whole[-1]


def records_of(rng, n):
    texts = ["plain", "}{", '"q"', "\\", "]", "a\\\"b}", "é}", "\n", "x" * 90]
    return [{"id": i, "t": rng.choice(texts), "n": {"l": [1, {"d": rng.choice(texts)}], "e": {}}, "z": rng.choice([None, 1.5])} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_in_many_ranges(spark, tmp_path, small_ranges, indent):
    wanted = records_of(random.Random(6), 80)
    path = put(tmp_path, "t.json", "\n " + json.dumps(wanted, indent=indent) + "\n")
    found = records(spark, path, JsonArray()).orderBy("file", "start", "seq").collect()
    assert [json.loads(r["text"]) for r in found] == wanted
    assert ranged(spark, path, "}").rdd.getNumPartitions() >= 5
    df = readers.read_table(spark, path, keep_order=True)
    assert [(r["id"], r["t"], r["n"]["l"] and r["z"]) for r in df.orderBy("__row_order").collect()] == [(w["id"], w["t"], w["z"]) for w in wanted]


def test_json_array_edges(spark, tmp_path):
    assert readers.read_json(spark, put(tmp_path, "e.json", "[ ]"), schema="a int").count() == 0
    assert readers.read_json(spark, put(tmp_path, "o.json", '[{"a": 1}]')).collect() == [(1,)]
    with pytest.raises(Exception, match="not an array of records"):
        readers.read_json(spark, put(tmp_path, "s.json", '["a", {"a": 1}]'))


@pytest.mark.parametrize("cells,kind", [
    (["1", "-2", "+3"], "bigint"),
    (["9007199254740993", "9223372036854775807"], "bigint"),
    (["9223372036854775808", "1"], "decimal(38,0)"),
    (["1" * 39], "string"),
    (["007", "1"], "string"),
    (["0", "0.5", "1e3"], "double"),
    (["9007199254740993", "0.5"], "decimal(38,1)"),
    (["9007199254740993", "1e3"], "string"),
    (["0.30000000000000004", "1.5"], "double"),
    (["0.1234567890123456789", "12.5"], "decimal(38,19)"),
    (["1" * 30 + ".5", "0." + "1" * 20], "string"),
    (["true", "False"], "boolean"),
    (["true", "1"], "string"),
    (["2024-01-02"], "string"),
    (["x", "1"], "string"),
    ([""], "string"),
])
def test_lattice_of_types(spark, tmp_path, cells, kind):
    df = readers.read_table(spark, put(tmp_path, "t.csv", "k,v\n" + "".join(f"a,{c}\n" for c in cells)))
    assert dict(df.dtypes)["v"] == kind
    got = [r["v"] for r in df.collect()]
    if kind.startswith(("bigint", "decimal")):
        assert [Decimal(g) for g in got] == [Decimal(c) for c in cells]
    elif kind == "string":
        assert got == [c or None for c in cells]
    elif kind == "double":
        assert got == [float(c) for c in cells]


def test_dates_where_asked(spark, tmp_path):
    path = put(tmp_path, "t.csv", "d,t,bad\n2024-01-02,2024-01-02 03:04:05,2024-02-31\n2024-01-03,2024-01-02,2024-01-01\n")
    df = readers.read_delimited(spark, path, dates=True)
    assert [t for _, t in df.dtypes] == ["date", "timestamp_ntz", "string"]


@pytest.mark.parametrize("quoted", [False, True])
def test_folder_by_header_names(spark, tmp_path, quoted):
    extra = '"br\neak"' if quoted else "plain"
    put(tmp_path, "1.csv", f"x,y\n1,{extra}\n2,b\n")
    put(tmp_path, "2 a.csv", "y,x,z\ntwo,99999999999,zz\n")
    put(tmp_path, "3.csv", "y,x\nthree,3\n")
    put(tmp_path, "4.csv", "")
    df = readers.read_delimited(spark, str(tmp_path), ",", keep_order=True)
    assert df.dtypes[:3] == [("x", "bigint"), ("y", "string"), ("z", "string")]
    rows = [tuple(r)[:3] for r in df.orderBy("__row_order").collect()]
    assert rows == [(1, "br\neak" if quoted else "plain", None), (2, "b", None), (99999999999, "two", "zz"), (3, "three", None)]


def test_headers_that_span_lines_in_a_folder(spark, tmp_path):
    put(tmp_path, "1.csv", '"a\nb",c\r\n1,2\r\n')
    put(tmp_path, "2.csv", 'c,"a\nb"\n3,4\n')
    df = readers.read_delimited(spark, str(tmp_path), ",")
    assert df.columns == ["a\nb", "c"] and sorted(map(tuple, df.collect())) == [(1, 2), (4, 3)]
