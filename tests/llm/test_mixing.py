from __future__ import annotations

import re
from collections import defaultdict

import pytest

from rowrinse.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, open_ = total - sum(fixed.values()), sum(weight[s] for s in free)
        goal = {s: rest * weight[s] / open_ for s in free} if free else {}
        over = [s for s in free if goal[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **goal}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_and_words(docs, rows):
    out = mixing.mix_plan(docs).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    goal = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1


def test_several_ranges_and_reruns_agree(docs, monkeypatch):
    first = sorted(map(str, mixing.mix_plan(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert sorted(map(str, mixing.mix_plan(docs.repartition(7)).collect())) == first


def test_curriculum(spark):
    from pyspark.sql import functions as F

    df = spark.range(11).select((F.col("id") / 10).alias("q"))
    knots = ((0.0, 2.0), (0.5, 1.0), (1.0, 1.0))
    areas = lambda t: 2 * t - t * t if t <= 0.5 else 0.75 + (t - 0.5)
    for q, t in df.select("q", mixing.invert(F.col("q"), knots)).collect():
        assert areas(t) == pytest.approx(1.25 * q)


def test_sequence(docs, rows):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    plan = defaultdict(int)
    for r in mixing.mix_plan(docs).collect():
        plan[r["source"]] += r["taken"]
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in plan.items() if n}


def test_heavy_sources_come_early(spark):
    df = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(600)], "doc_id bigint, text string, source string")
    at = defaultdict(list)
    for r in mixing.mix_plan(df).filter("taken > 0").collect():
        at[r["source"]].append(r["position"])
    mean = {s: sum(x) / len(x) for s, x in at.items()}
    assert mean["a"] < mean["b"] < mean["c"]


def test_empty(empty):
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_query_counts_what_the_mix_reads(spark, tmp_path, monkeypatch):
    """``taken`` is counted on the texts of the sequence: one that reads a word less is told apart."""
    from pyspark.sql import functions as F

    from rowrinse.llm import queries

    rows = [(i, f"w{i} " * (i % 7), "abc"[i % 3] if i % 11 else None, "en", 0) for i in range(90)] + [(3, "x y z", "a", None, 0)] * 2 + [(None, None, "b", None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", "size", "source_size", "target", "taken", "position_ppm"))
    out = queries.op4_mix_sources(spark, str(tmp_path)).collect()
    wanted = mixing.mix_plan(df).selectExpr("id as doc_id", "size", "source_size", "target", "taken", "floor(position * 1000000) as position_ppm")
    assert sorted(map(key, out)) == sorted(map(key, wanted.collect()))
    in_sequence = sum(len(r["text"].split()) for r in mixing.mix(df).collect())
    assert sum(r["taken"] for r in out) == in_sequence > 0
    monkeypatch.setattr(mixing, "reads", lambda *a, f=mixing.reads, **k: f(*a, **k).withColumn(
        "reads", F.expr("transform(reads, r -> named_struct('position', r.position, 'text', concat(r.text, ' more')))")))
    more = queries.op4_mix_sources(spark, str(tmp_path)).collect()
    assert sum(r["taken"] for r in more) > in_sequence


def test_query_gives_the_whole_sequence(spark, tmp_path, monkeypatch):
    """The places of all reads and the digests of their texts are those of the sequence that ``mix`` gives, row by row."""
    import hashlib

    from rowrinse.llm import queries

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(i % 70, f"w{i} " * (i % 9), "abc"[i % 3] if i % 11 else None, 0) for i in range(140)] + [(7, "x y z", "a", 0)] * 3 + [(None, None, "b", 0), (None, "u v", "c", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_mix_sources(spark, str(tmp_path)).collect()
    wanted = [(r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest()) for r in mixing.mix(df).collect()]
    placed = {p: (r["doc_id"], d) for r in out for p, d in zip(r["places"], r["texts_md5"], strict=True)}
    assert [placed[p] for p in range(len(wanted))] == wanted and len(placed) == sum(r["n_reads"] for r in out) == len(wanted)
    assert any(r["n_reads"] > 1 for r in out) and len(out) == len(rows)
    assert all((r["position_ppm"] is None) == (r["n_reads"] == 0) and r["places"] == sorted(r["places"]) for r in out)
