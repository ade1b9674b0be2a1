from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowrinse.operators import match

TEXTS = ["alpha", "Alphabet", "beta", "a.b", "ab", "", " beta", None, "gamma ray", "α-ray"]


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, t string")


def brute(keys, keep, how):
    keys = [k.strip() for k in keys if k and k.strip()]

    def hit(t):
        if how == "contains":
            return any(k in t for k in keys)
        if how == "case_insensitive":
            return t.lower() in {k.lower() for k in keys}
        return t in keys

    return sorted(i for i, t in enumerate(TEXTS) if t is not None and hit(t) == keep)


def ids(df):
    return sorted(r[0] for r in df.select("n").collect())


KEYS = [" beta ", "ALPHA", "a.", "ray", "ray", "", None, "  ", "abcdefgh"]


@pytest.mark.parametrize("how", ["exact", "case_insensitive", "contains"])
@pytest.mark.parametrize("mode", ["keep", "exclude"])
@pytest.mark.parametrize("as_table", [False, True])
def test_modes(spark, table, how, mode, as_table):
    keys = spark.createDataFrame([(k,) for k in KEYS], "k string") if as_table else KEYS
    assert ids(match.match_keys(table, "t", keys, mode, how)) == brute(KEYS, mode == "keep", how)


def test_keep_exclude_and_null_make_the_whole(table):
    kept = match.match_keys(table, "t", ["beta", "ab"]).count()
    left = match.match_keys(table, "t", ["beta", "ab"], "exclude").count()
    assert kept + left + table.filter("t is null").count() == table.count()


def test_no_ops(table):
    assert match.match_keys(table, "zz", ["a"]).count() == len(TEXTS)
    assert match.match_keys(table, "t", ["", " "]).count() == len(TEXTS)
    assert match.match_keys(table, "t", None).count() == len(TEXTS)


def test_numbers_match_as_text(table):
    assert ids(match.match_keys(table, "n", ["3", "5"])) == [3, 5]


@pytest.mark.parametrize("how", ["exact", "case_insensitive", "contains"])
@pytest.mark.parametrize("mode", ["keep", "exclude"])
def test_long_lists_agree_with_short_ones(table, how, mode):
    """Past the literal limits the join and the automaton give the same rows."""
    padded = KEYS + [f"absent-{i}" for i in range(match.LITERAL_KEYS + 1)]
    assert ids(match.match_keys(table, "t", padded, mode, how)) == brute(padded, mode == "keep", how)


def test_more_than_500_substrings_all_count(spark):
    df = spark.createDataFrame([(i, f"row {i} key-{i}-end") for i in range(1500)], "n int, t string")
    assert match.match_keys(df, "t", [f"key-{i}-" for i in range(0, 1500, 2)], how="contains").count() == 750


@pytest.mark.parametrize("mode", ["keep", "exclude"])
def test_gram_join_against_brute_force(spark, table, mode):
    keys = spark.createDataFrame([(k,) for k in KEYS], "k string")
    assert ids(match.match_keys(table, "t", keys, mode, "contains")) == brute(KEYS, mode == "keep", "contains")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.text("ab\nc", max_size=12), min_size=1, max_size=12),
    keys=st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=6, unique=True),
)
def test_gram_join_property(spark, texts, keys):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    table = spark.createDataFrame([(k,) for k in keys], "__key string")
    kept = match.contains_by_grams(df, F.col("t"), table, True, widths=(1, 2, 3))
    assert ids(kept) == [i for i, t in enumerate(texts) if any(k in t for k in keys)]


@pytest.mark.parametrize("how", ["exact", "case_insensitive", "contains"])
@pytest.mark.parametrize("mode", ["keep", "exclude"])
def test_an_empty_key_table_changes_nothing(spark, table, how, mode):
    none = spark.createDataFrame([(" ",), (None,)], "k string")
    assert match.match_keys(table, "t", none, mode, how).count() == len(TEXTS)


def test_long_keys_and_texts(spark):
    """The keys' length changes nothing in what is shuffled, and a common start is not looked up."""
    base = "common start of every key " * 400
    df = spark.createDataFrame([(i, f"{base}{i:04d} end" if i % 2 else f"{base[:-1]}") for i in range(200)], "n int, t string")
    keys = spark.createDataFrame([(f"{base}{i:04d}",) for i in range(0, 200)], "k string")
    kept = match.match_keys(df, "t", keys, how="contains")
    assert ids(kept) == list(range(1, 200, 2))
    assert "{1," not in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["exclude", "keep"])
def test_grams_that_no_key_has_are_not_written(spark, monkeypatch, mode):
    """Long texts and few keys: what is staged grows with the grams they share, not with the texts."""
    staged, write = [], match.__dict__.get("stage")
    monkeypatch.setattr(match, "stage", lambda df: staged.append(write(df)) or staged[-1], raising=False)
    rows = [(i, hashlib.shake_256(b"%d" % i).hexdigest(500) + (" ñandú öl" if i % 10 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, t string")
    keys = spark.createDataFrame([("ñandú ö",), ("l ñandú",), ("ú",)], "k string")
    found = ids(match.match_keys(df, "t", keys, mode, "contains"))
    assert found == [i for i in range(200) if (i % 10 == 0) == (mode == "keep")]
    assert staged and sum(s.count() for s in staged) < 1000  # the texts have some 200,000 grams


def test_grams_across_blocks_of_places(spark, monkeypatch):
    monkeypatch.setattr(match, "PLACES", 7)
    texts = ["", "aé", "xxaéb", "xxxxxxxxxxxxaébxxxxx", "aéaéaéaéb", "bxaé", "é", "😀aéb😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for k in ("aéb", "é", "b", "aéaéaéaéb", "😀aé", "xx"):
        keys = spark.createDataFrame([(k,), ("absent from all",)], "k string")
        assert ids(match.match_keys(df, "t", keys, how="contains")) == [i for i, t in enumerate(texts) if k in t]


@pytest.mark.parametrize("mode", ["exclude", "keep"])
def test_texts_are_shuffled_once_at_most(spark, monkeypatch, mode, tmp_path):
    """Grams are taken where the texts are read, and the join carries one text a row; copies and files as well."""
    plans, write = [], match.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(match, "stage", lambda df: plans.append(plan(df)) or write(df))
    rows = [(i, f"text {i % 100} {'ñandú öl' if i % 20 == 0 else ''}") for i in range(400)]
    spark.createDataFrame(rows, "n int, t string").write.parquet(f"{tmp_path}/texts")
    keys = spark.createDataFrame([("ñandú ö",), ("l ñandú",)], "k string")
    found = match.match_keys(spark.read.parquet(f"{tmp_path}/texts"), "t", keys, mode, "contains")
    assert ids(found) == [i for i in range(400) if (i % 20 == 0) == (mode == "keep")]
    assert [p for p in plans if "__text" in p] and not any("Exchange" in p for p in plans if "__text" in p)
    assert "__text" not in plan(found)
