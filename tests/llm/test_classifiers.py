from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowrinse.llm import language, toxicity

SF = "/root/testdata/sf0.1"


def test_segments_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.normal(-0.3, 2, 12)  # no ties, of which any may be taken
        left, wanted = [(0, len(s))], []
        while left:  # the definition: the best segment, then those at its left and right
            a, b = left.pop()
            spans = [(sum(s[i:j]), -i, -(j - i)) for i, j in itertools.combinations(range(a, b + 1), 2)]
            best = max(spans, default=(0, 0, 0))
            if best[0] > 0:
                i, j = -best[1], -best[1] - best[2]
                wanted.append((i, j, best[0]))
                left += [(a, i), (j, b)]
        found = toxicity.segments(s)
        assert sum(x[2] for x in found) == pytest.approx(sum(x[2] for x in wanted))
        assert max((x[2] for x in found), default=0) == pytest.approx(max((x[2] for x in wanted), default=0))


def test_toxicity_on_held_out_documents(spark, docs, empty):
    whole, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(whole, labels)
    out = toxicity.score(whole, model).join(labels, F.col("id") == F.col("doc_id")).filter("held_out").collect()
    clean = [r for r in out if r["toxic"] == 0]
    named = [r for r in out if r["toxic"] == 1]
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.01
    # a third of the labels have nothing in the text to go by
    assert sum(r["predicted"] for r in named) / len(named) > 0.45
    assert all(0 <= r["score"] <= 1 and (not r["predicted"] or r["passages"]) for r in out)
    small = toxicity.score(docs, model).collect()
    assert len(small) == docs.count() and all(r["score"] is not None for r in small)
    assert toxicity.score(empty, model).count() == 0


def test_fit_weighs_all_segments_of_a_long_text(spark, monkeypatch):
    quiet = "calm " * 60
    texts = [(i, ("vile " * 30 + quiet) * 80 if i % 2 else quiet * 5) for i in range(1200)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id bigint, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, real=toxicity.logistic: fitted.append((x, y)) or real(x, y))
    model = toxicity.fit(docs, labels)
    scores = model.score[toxicity.buckets(texts[1][1])].astype(float)
    found = toxicity.segments(scores)
    assert len(found) > 64
    wanted = toxicity.evidence([v * model.rate for _, _, v in found], len(scores), model.log_k)
    x, y = fitted[0]
    assert wanted > 0 and abs(x[y > 0] - wanted).max() < 1e-4


def test_toxicity_without_labels(docs, spark):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}


def test_language_on_held_out_documents(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predict(whole, language.fit(whole)).join(whole, F.col("id") == F.col("doc_id")).filter(language.held_out("doc_id")).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.95


def test_language_of_odd_texts(docs, rows, empty):
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    by_id = {r["id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and by_id[0]["score"] == 0
    assert by_id[4]["lang_pred"] != "und"
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0
