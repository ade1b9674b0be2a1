from __future__ import annotations

import re
from collections import Counter

from rowrinse.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(windows)
    twice = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            twice |= set(range(i, i + 5))
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice))


def test_counts(docs, rows):
    out = quality.judge(docs).collect()
    key = lambda x: tuple(map(str, x))
    wanted = sorted(((r[0], *brute(r[1])) for r in rows), key=key)
    assert sorted(((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out), key=key) == wanted
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    got = labels.join(out, labels["doc_id"] == out["id"]).filter("not base_failed").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in got)
    assert right / len(got) > 0.95
    clean = [r for r in got if r["quality"] == 1]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.98


def test_filter(docs, empty, rows):
    out = quality.drop_low_quality(docs)
    kept = {r["id"] for r in quality.judge(docs).filter("kept").select("id").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept and out.columns == docs.columns
    assert quality.judge(empty).count() == 0 and quality.drop_low_quality(empty).count() == 0


def test_em_needs_no_patterns():
    prior, weights = quality.fit({})
    assert prior == 0 and len(weights) == len(quality.RULES)
