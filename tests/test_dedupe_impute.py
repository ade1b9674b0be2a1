from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from rowrinse.operators import dedupe, impute, ordering
from rowrinse.operators.ordering import ORDER


@pytest.fixture
def people(spark):
    data = [
        (0, "Ann", "Lee", 1), (1, " ann", "LEE ", 2), (2, "Bob", None, 3), (3, "bob", None, 4), (4, None, None, 5),
        (5, None, None, 6), (6, "Ann", "", 7), (7, "Ann", "Lee", 1),
    ]
    return spark.createDataFrame(data, "n int, first_name string, last_name string, v int")


def test_first_and_last(people, values):
    assert values(dedupe.dedupe(people, order_by=["n"]), "n") == [(0,), (2,), (4,), (6,)]
    assert values(dedupe.dedupe(people, keep="last", order_by=["n"]), "n") == [(3,), (5,), (6,), (7,)]


def test_stored_text_is_unchanged(people, values):
    out = dedupe.dedupe(people.filter("n in (1, 7)"), order_by=["n"])
    assert values(out, "first_name", "last_name") == [(" ann", "LEE ")]


def test_whole_rows(people, values):
    assert dedupe.dedupe(people.drop("n"), "all_columns").count() == 7
    marked = people.withColumnRenamed("n", ORDER)
    assert values(dedupe.dedupe_rows(marked, "last"), ORDER) == [(1,), (2,), (3,), (4,), (5,), (6,), (7,)]
    assert values(dedupe.dedupe_rows(marked, "first"), ORDER) == [(0,), (1,), (2,), (3,), (4,), (5,), (6,)]


def test_normalized_rows(spark, values):
    data = [(0, "a", None), (1, " A ", ""), (2, "a", "|"), (3, "a|", "")]
    df = spark.createDataFrame(data, f"{ORDER} int, x string, y string")
    assert values(dedupe.dedupe_rows_normalized(df), ORDER) == [(0,), (2,), (3,)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_hot_key_and_partition_count(spark, parts):
    """A third of all rows share one key; the survivors do not depend on the partitioning."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("name")
    )
    out = dedupe.dedupe(df.repartition(parts), "custom", ["name"], "last", ["id"])
    expected = {}
    for i in range(3000):
        expected["hot" if i % 3 == 0 else f"k{i % 50}"] = i
    assert {r["name"]: r["id"] for r in out.collect()} == expected


@pytest.fixture
def gaps(spark):
    rnd = random.Random(7)
    data = [
        (i, rnd.choice([None, None, None, i]), rnd.choice([None, f"t{i}", ""]), None) for i in range(500)
    ]
    data[0] = (0, None, None, None)
    data[-1] = (499, None, None, None)
    return data, spark.createDataFrame(data, "n int, a int, t string, e double").repartition(7)


@pytest.mark.parametrize("forward", [True, False])
def test_fill_along_against_brute_force(gaps, forward):
    data, df = gaps
    out = impute.fill_missing(df, "forward" if forward else "backward", columns=["a", "t", "e"], order_by=["n"])
    assert out.columns == df.columns
    expected, last = [], [None, None, None]
    for row in data if forward else reversed(data):
        last = [v if v is not None else seen for v, seen in zip(row[1:], last)]
        expected.append((row[0], *last))
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)


@pytest.mark.parametrize("forward", [True, False])
def test_fill_along_files(spark, gaps, tmp_path, monkeypatch, forward):
    """Blocks of file positions give the same as blocks cut by a sort."""
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 40)
    _, df = gaps
    df.repartitionByRange(3, "n").sortWithinPartitions("n").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    mode = "forward" if forward else "backward"
    expected = sorted(tuple(r) for r in impute.fill_missing(df, mode, order_by=["n"]).collect())
    out = impute.fill_missing(stored, mode)
    assert sorted(tuple(r) for r in out.collect()) == expected
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text
    kept = impute.fill_missing(ordering.with_order(stored).filter("n % 3 <> 0"), mode)
    cut = impute.fill_missing(df.filter("n % 3 <> 0"), mode, order_by=["n"])
    assert sorted(tuple(r) for r in kept.drop(ORDER).collect()) == sorted(tuple(r) for r in cut.collect())


def test_fill_modes(spark, values):
    df = spark.createDataFrame([(1, None, None), (None, "", 2.0), (4, "x", None)], "i int, t string, d double")
    assert values(impute.fill_missing(df, "empty_str")) == [("", "", "2.0"), ("1", "", ""), ("4", "x", "")]
    assert values(impute.fill_missing(df, "custom", "7")) == [(1.0, "7", 7.0), (4.0, "x", 7.0), (7.0, "", 2.0)]
    assert values(impute.fill_missing(df, "custom", "n", ["i"]), "i") == [("1",), ("4",), ("n",)]
    assert values(impute.fill_missing(df, "zero")) == [(0, "", 2.0), (1, "0", 0.0), (4, "x", 0.0)]
    assert dict(impute.fill_missing(df, "zero").dtypes)["i"] == "int"
    assert values(impute.fill_missing(df, "mean", columns=["i", "t"])) == [(1.0, None, None), (2.5, "", 2.0), (4.0, "x", None)]
    assert values(impute.fill_missing(df, "median"), "i", "d") == [(1.0, 2.0), (2.5, 2.0), (4.0, 2.0)]
    assert values(impute.fill_missing(df, None)) == values(df)
    assert values(impute.fill_missing(df, "custom", None)) == values(df)
    empty = df.withColumn("d", F.lit(None).cast("double"))
    assert values(impute.fill_missing(empty, "median", columns=["d"]), "d") == [(None,), (None,), (None,)]
    assert values(impute.blanks_to_null(df), "t") == [("x",), (None,), (None,)]


@pytest.mark.parametrize("exact_rows", [10, 10_000])
@pytest.mark.parametrize("n", [1000, 1001])
def test_median_by_narrowing(spark, exact_rows, n):
    """Skewed values, most of them equal, and an odd or even count."""
    rnd = random.Random(n)
    hot = [3.0] * (n // 3)
    x = hot + [rnd.gauss(10, 50) for _ in range(n - len(hot))]
    y = [float(i % 17) for i in range(n)]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double").repartition(4)
    found = impute.medians(df, ["x", "y"], exact_rows)
    assert found["x"] == pytest.approx(statistics.median(x), abs=1e-12)
    assert found["y"] == statistics.median(y)


def test_row_index_and_group_index(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("g"))
    blocks = ordering.in_blocks(df, F.col("g").asc_nulls_last(), F.col("id"))
    assert blocks.select(ordering.BLOCK).distinct().count() > 1
    rows = [(r["g"], r["id"], r["at"]) for r in ordering.with_row_index(blocks, "at").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[2] for r in ordered] == list(range(1000))
    seen = {}
    grouped = [(r["g"], r["id"], r["at"]) for r in ordering.with_group_index(blocks, "g", "at").collect()]
    for g, _, at in sorted(grouped, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        assert at == seen.get(g, 0)
        seen[g] = at + 1
    assert sum(seen.values()) == 1000


@pytest.mark.parametrize("n", [1, 3, 20, 5000])
def test_first_rows(spark, n):
    """More, as many and fewer tasks than rows wanted."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias(ORDER)).repartition(12)
    assert [r[0] for r in ordering.first_rows(df, n).collect()] == list(range(min(n, 1000)))


def test_sort_directions_stay_with_their_columns(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "n int, t string")
    by = lambda *a, **k: [r["n"] for r in ordering.sort_rows(df, *a, **k).collect()]
    assert by(["t"]) == [3, 1, 2]
    assert by(["t"], [True]) == [1, 3, 2]
    assert by(["t"], [True], nulls_last=False) == [2, 1, 3]
    assert by(["t"], nulls_last=False) == [2, 3, 1]
    assert by(["zz", "n"], [False, True]) == [3, 2, 1]


def test_file_order_is_the_order_in_the_files(spark, tmp_path):
    spark.range(1000).repartition(1).sortWithinPartitions(F.hash("id")).write.parquet(str(tmp_path / "t.parquet"))
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    got = [r["id"] for r in ordering.with_order(df).orderBy(ORDER).collect()]
    assert got == [r["id"] for r in spark.range(1000).orderBy(F.hash("id")).collect()]


def test_a_joined_table_has_no_order_of_its_own(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey", "o_orderkey")
    joined = orders.join(orders.groupBy("o_custkey").count(), "o_custkey")
    with pytest.raises(ValueError, match="order_by"):
        dedupe.dedupe(joined, "custom", ["o_custkey"])
    first = dedupe.dedupe(joined, "custom", ["o_custkey"], order_by=["o_orderkey"])
    assert first.count() == orders.select("o_custkey").distinct().count()
    assert dedupe.dedupe(orders, "custom", ["o_custkey"]).count() == first.count()
