from __future__ import annotations

import json
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from registry import files
from rowrinse import session
from rowrinse.sinks import category, writers
from rowrinse.sources import lookup, readers


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def lines_of(folder, pattern="part-*"):
    """All data lines of a written folder in file order, headers left out."""
    out = []
    for part in sorted(pathlib.Path(folder).glob(pattern)):
        out += part.read_text(encoding="utf-8").splitlines()[1:]
    return out


def test_csv_types_quotes_and_ragged_rows(spark, tmp_path):
    path = put(
        tmp_path,
        "t.csv",
        'id,name,price,ok,day\n1,"a, ""b""",1.5,true,2024-01-02\n2,  pad ,2,False,2024-01-03\n3,short\n4,x,3e2,true,d,extra\n',
    )
    df = readers.read_table(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "price": "double", "ok": "boolean", "day": "string"}
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[0] == (1, 'a, "b"', 1.5, True, "2024-01-02")
    assert rows[1] == (2, "  pad ", 2.0, False, "2024-01-03")
    assert rows[2] == (3, "short", None, None, None)
    assert rows[3] == (4, "x", 300.0, True, "d")


def test_types_are_judged_by_all_cells(spark, tmp_path):
    rows = "".join(f"{i},{i}\n" for i in range(12_000))
    df = readers.read_table(spark, put(tmp_path, "t.csv", "a,b\n" + rows + "A-17,1.5\nB-9,2\n"))
    assert dict(df.dtypes) == {"a": "string", "b": "double"}
    assert df.filter("a in ('A-17', 'B-9')").count() == 2 and df.filter("b is null").count() == 0


def test_header_that_spans_lines(spark, tmp_path):
    df = readers.read_table(spark, put(tmp_path, "t.csv", '"a\nb",c\n1,2\n'))
    assert df.columns == ["a\nb", "c"] and df.collect() == [(1, 2)]


def test_records_that_span_lines(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'a,b\n1,"two\nlines"\n2,one\n')
    assert readers.has_quoted_breaks(spark, path)
    assert sorted(tuple(r) for r in readers.read_table(spark, path).collect()) == [(1, "two\nlines"), (2, "one")]


@pytest.mark.parametrize("sep,name", [(",", "t.csv"), (";", "t.txt"), ("\t", "t.tsv"), ("|", "t.dat"), ("|", "t.csv")])
def test_separators(spark, tmp_path, sep, name):
    path = put(tmp_path, name, f"a{sep}b\n1{sep}x, y\n2{sep}z\n" if sep != "," else "a,b\n1,x\n2,z\n")
    df = readers.read_table(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 2


def test_header_repair(spark, tmp_path):
    assert readers.repair_header(["a", "", "a", None, "a"]) == ["a", "col_1", "a_duplicated_0", "col_3", "a_duplicated_1"]
    df = readers.read_table(spark, put(tmp_path, "t.csv", "x.y,,x.y\n1,2,3\n"))
    assert df.columns == ["x.y", "col_1", "x.y_duplicated_0"] and tuple(df.first()) == (1, 2, 3)


def test_empty_and_spreadsheet_files(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_table(spark, put(tmp_path, "t.csv", ""))
    with pytest.raises(ValueError):
        readers.read_table(spark, "t.xlsx")


@pytest.mark.parametrize("text", ['[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]', '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n'])
def test_json(spark, tmp_path, text):
    df = readers.read_table(spark, put(tmp_path, "t.json", text))
    assert sorted(tuple(r) for r in df.select("a", "b").collect()) == [(1, "x"), (2, None)]


def test_order_of_a_text_file(spark, tmp_path):
    numbers = [(i * 7919) % 1000 for i in range(1000)]
    path = put(tmp_path, "t.csv", "n\n" + "\n".join(map(str, numbers)) + "\n")
    df = readers.read_table(spark, path, keep_order=True)
    assert [r["n"] for r in df.orderBy("__row_order").collect()] == numbers


def test_lookup(spark, tmp_path):
    path = tmp_path / "keys.txt"
    path.write_bytes("A1, 'B2';;C3\tA1\r\n\"D 4\" ,'\"e\"',\"'f'\",caf\xe9,ü\n ,\"\"\n".encode("latin-1").replace(b"\xfc", "ü".encode()))
    keys = lookup.read_lookup(spark, str(path)).orderBy("first_seen")
    assert [r["key"] for r in keys.collect()] == ["A1", "B2", "C3", "D 4", '"e"', "f", "caf", "ü"]


@pytest.fixture
def table(spark):
    data = [
        (0, " India", 5.0), (1, "India", None), (2, None, 1.0), (3, "a/b", 2.0), (4, "A/B", 3.0), (5, "a_b_1", 4.0),
        (6, " ", 9.0), (7, "India", 7.0),
    ]
    return spark.createDataFrame(data, "n int, place string, v double")


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet", "json"])
def test_formats_come_back_whole(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "q", b', " pad "), (2, "tab\there", None)], "n bigint, t string, p string")
    path = str(tmp_path / f"out.{fmt}")
    writers.write_table(df, path, fmt)
    back = readers.read_table(spark, path).select("n", "t", "p")
    assert sorted(tuple(r) for r in back.collect()) == [(1, 'a "q", b', " pad "), (2, "tab\there", None)]


def test_json_keeps_null_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "n int, t string")
    writers.write_table(df, str(tmp_path / "j"), "json")
    [part] = [p for p in (tmp_path / "j").glob("part-*") if p.stat().st_size]
    assert json.loads(part.read_text()) == {"n": 1, "t": None}


def test_unknown_format(table, tmp_path):
    with pytest.raises(ValueError, match="formats: csv"):
        writers.write_table(table, str(tmp_path / "x"), "xlsx")


def test_nested_values_in_text_formats(spark, tmp_path):
    df = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"))
    writers.write_table(df, str(tmp_path / "x"), "csv")
    assert lines_of(tmp_path / "x") == ['"[1,2]"'] or lines_of(tmp_path / "x") == ["[1,2]"]


def test_segments_are_in_order_and_bounded(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(6)
    done = writers.write_segments(df, str(tmp_path / "s"), "csv", ["k"], order_by=["id"], sheet_rows=400, segment_rows=300)
    assert done == {"rows": 1000, "sheets": 4}
    got = [lines_of(tmp_path / "s" / f"sheet=Cleaned_Data_Part_{i}") for i in range(1, 5)]
    assert [len(g) for g in got] == [300, 300, 300, 100]
    assert [int(x.split(",")[0]) for g in got for x in g] == list(range(1000))
    one = writers.write_segments(df, str(tmp_path / "o"), "csv", ["k"], order_by=["id"], sheet_rows=1000, segment_rows=300)
    assert one["sheets"] == 1
    assert [int(x.split(",")[0]) for x in lines_of(tmp_path / "o" / "sheet=Cleaned_Data")] == list(range(1000))


def test_sorted_export(spark, table, tmp_path):
    done = category.write_by_category(
        table, "place", str(tmp_path), "sorted_unified", secondary_sort_column="v", secondary_sort_descending=True, order_by=["n"])
    assert done["total_rows"] == 8 and done["total_categories"] == 7 and done["path"].endswith("sorted_by_place")
    assert [int(x.split(",")[0]) for x in lines_of(done["path"])] == [6, 0, 4, 7, 1, 3, 5, 2]


def test_split_into_files(spark, table, tmp_path):
    done = category.write_by_category(table, "place", str(tmp_path), "zip", order_by=["n"], selected_categories=["India", "a/b", ""])
    names = {p.name for p in (tmp_path / "by_place" / "data").iterdir() if p.is_dir()}
    assert names == {"file=India", "file=a_b", "file=Blank_Unspecified", "file=Blank_Unspecified_1"}
    summary = sorted(lines_of(done["summary"]))
    assert summary == ["Blank_Unspecified,Blank_Unspecified.csv,1", "Blank_Unspecified,Blank_Unspecified_1.csv,1", "India,India.csv,2", "a/b,a_b.csv,1"]


def test_split_into_sheets(spark, table, tmp_path):
    done = category.write_by_category(table, "place", str(tmp_path), "sheets", order_by=["n"], sheet_rows=1)
    names = sorted(str(p.relative_to(tmp_path / "by_place" / "data")) for p in (tmp_path / "by_place" / "data").glob("*/*"))
    assert names == sorted(
        f"sheet_title={t}/sheet_no={n}"
        for t, n in [("Blank_Unspecified", 1), ("Blank_Unspecified_1", 1), ("India", 1), ("India_1", 1), ("India_1", 2),
                     ("A_B", 1), ("a_b_1", 1), ("a_b_1_1", 1)]
    )
    assert lines_of(done["summary"])[-1] == "TOTAL,8,1.0"
    assert lines_of(done["summary"])[0] == "India,2,0.25"
    plain = category.write_by_category(table, "place", str(tmp_path / "p"), "sheets", include_summary_sheet=False, order_by=["n"])
    assert "summary" not in plain


def test_hot_category_is_cut_into_sheets(spark, tmp_path):
    """One category holds most rows; all of them arrive, in order, sheet by sheet."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("c"))
    done = category.write_by_category(df, "c", str(tmp_path), "sheets", order_by=["id"], sheet_rows=500)
    got = []
    for n in (1, 2, 3):
        part = [int(x.split(",")[0]) for x in lines_of(f"{done['path']}/data/sheet_title=hot/sheet_no={n}")]
        assert len(part) == (500 if n < 3 else 400)
        got += part
    assert got == [i for i in range(2000) if i % 10 < 7]


def serial_names(bases, limit, render, reserved):
    """The names given one after the other."""
    seen, out = {r.lower() for r in reserved}, []
    for base in bases:
        k = 0
        while render(base, k).lower() in seen:
            k += 1
        out.append(render(base, k))
        seen.add(out[-1].lower())
    return out


def test_names_agree_with_naming_one_by_one(spark):
    cats = ["A", "A_1", "A_1_1", "Overview_Summary", "a", "a_1", "a_2", "aa", "b", "B", "b_1", "B_1", "b_2", "c" * 33, "C" * 32, "c" * 29 + "_1", "c" * 29 + "_2"]
    cats = sorted(set(cats))

    def render(base, k):
        return base[:31] if k == 0 else base[: 31 - len(f"_{k}")] + f"_{k}"

    df = spark.createDataFrame([(c,) for c in cats], "category string")
    got = {r["category"]: r["name"] for r in category.sheet_titles(df).collect()}
    assert [got[c] for c in cats] == serial_names(cats, 31, render, ["Overview_Summary"])


def test_errors(table, tmp_path):
    with pytest.raises(ValueError, match="category column"):
        category.write_by_category(table, "zz", str(tmp_path))
    with pytest.raises(ValueError, match="export mode"):
        category.write_by_category(table, "place", str(tmp_path), "pdf")
    for mode in category.MODES:
        with pytest.raises(ValueError, match="no rows"):
            category.write_by_category(table, "place", str(tmp_path), mode, selected_categories=["nowhere"])


def test_writers_leave_no_scratch(spark, table, tmp_path, monkeypatch):
    """What is staged on the way to a written result is gone afterwards; what was staged before stays."""
    folder = tmp_path / "scratch"
    monkeypatch.setattr(session, "scratch_path", lambda _: str(folder / uuid.uuid4().hex))
    kept = session.stage(table)
    category.write_by_category(kept, "place", str(tmp_path / "out"), "zip", "parquet", order_by=["n"])
    writers.write_segments(kept, str(tmp_path / "segments"), "parquet", order_by=["n"])
    assert len(list(folder.iterdir())) == 1 and kept.count() == table.count()
    with session.scratch_scope(spark):
        assert session.stage(table).count() == table.count() and len(list(folder.iterdir())) == 2
    assert len(list(folder.iterdir())) == 1


def test_long_ids_beyond_bigint(spark, tmp_path):
    """Tables of many keys make ids of 19 digits that a bigint cannot hold; none is lost."""
    for name, keys, kind in (("few", [0, 7, None, 4_775_807], "bigint"), ("many", [1, None, 4_775_808, 9_000_000], "decimal(38,0)")):
        spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        out = files.QUERIES["scan_csv_long_ids"][0](spark, f"{tmp_path}/{name}")
        assert out.first()["id19_type"] == kind
        found = {r["id19"]: r["id20"] for r in out.collect()}
        assert found == {None if k is None else str(9223372036850000000 + k): None if k is None else f"1{k:019d}" for k in keys}
