"""The stages of the pipeline, each against brute force on its own input, and the whole run."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from rowrinse.llm import quality
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import closure

WORD = re.compile("[^\x20\x09-\x0d]+")
RULES = ("length", "word_length", "symbols", "shouting", "dup_lines", "repeats", "letters")


def shingled(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(a, b):
    return a == b or (bool(a and b) and len(a & b) >= 0.8 * len(a | b))


def brute_kept_by_rules(rows):
    """Base rules and the posterior of the votes, which are counted again here."""
    facts = []
    for doc in rows:
        text = doc["text"] or ""
        n_words, chars, symbols, dup, repeated = brute_counts(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        letters = sum(c.isalpha() for c in text)
        capitals = sum(c.isupper() and c.isalpha() for c in text)
        n, mean = max(n_words, 1), chars / max(n_words, 1)
        vote = lambda bad, good: -1 if bad else 1 if good else 0
        facts.append((doc, n_words, repeated, (
            vote(n_words < 10, n_words >= 50), vote(mean < 2.5 or mean > 12, 3.5 <= mean <= 9),
            vote(20 * symbols > n, 100 * symbols < n), vote(3 * capitals > letters, 5 * capitals < letters),
            vote(10 * dup > 3 * lines, dup == 0 and lines >= 3), vote(10 * repeated > n, repeated == 0 and n >= 50),
            vote(2 * letters < chars, 10 * letters > 8 * chars))))
    _, weights = quality.fit(dict(Counter(f[3] for f in facts)))
    import math

    def good(votes):
        odds = [math.exp(min(start + sum(w[v] for w, v in zip(ratios, votes)), 500)) for start, ratios in weights]
        return 1 / (1 + sum(odds))

    return [d for d, n, repeated, votes in facts if n >= 10 and 100 * repeated <= 20 * n and good(votes) >= 0.5]


def brute_distinct(rows):
    sets = [shingled(r["text"]) for r in rows]
    roots = closure(len(rows), lambda i, j: (rows[i]["text"] or "") == (rows[j]["text"] or "") or alike(sets[i], sets[j]))
    least = {}
    for r, root in zip(rows, roots):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    return [r for r, root in zip(rows, roots) if r["doc_id"] == least.get(root)]


def brute_cut(rows, length):
    data = [(r["text"] or "").encode() for r in rows]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for r, d in zip(rows, data):
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out.append((r["doc_id"], bytes(b for b, g in zip(d, gone) if not g).decode(errors="ignore")))
    return out


@pytest.fixture(scope="module")
def results(spark, docs):
    """The rows that each stage is given and returns."""
    out, rows = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(stage(spark, rows, "").collect(), None) if name == corpus_pipeline.STAGES[-1][0] else None
        if after is None:
            made = stage(spark, rows, "")
            after = spark.createDataFrame(made.collect(), made.schema)
        out[name] = rows.collect(), after.collect()
        rows = after
    return out


def key(rows):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in rows)


def test_rules(results):
    given, kept = results["quality_rules"]
    assert key(kept) == key(brute_kept_by_rules(given)) and 0 < len(kept) < len(given)


def test_near_copies(results):
    given, kept = results["simhash_near_dedup"]
    assert key(kept) == key(brute_distinct(given)) and 0 < len(kept) < len(given)


def test_repeated_passages(results):
    given, kept = results["suffix_array_dedup"]
    assert sorted(map(str, brute_cut(given, corpus_pipeline.REPEATED))) == sorted(str((r["doc_id"], r["text"] or "")) for r in kept)
    assert any(len(a[1]) < len(b["text"] or "") for a, b in zip(brute_cut(given, corpus_pipeline.REPEATED), given))


def test_mixture(results):
    given, kept = results["mix_sources"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in given:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in kept:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    for source, goal in brute_targets(sizes).items():
        assert abs(taken[source] - goal) <= 1
    texts = {r["doc_id"]: r["text"] for r in given}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in kept)


def test_pieces(results):
    given, kept = results["sentencepiece"]
    assert len(kept) == len(given)
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in kept) == key(given)


def test_run_is_its_stages(spark, docs, results, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in out) == sorted((str(r["doc_id"]), r["decoded"]) for r in results["sentencepiece"][1])


def test_empty(spark, empty):
    rows = empty
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "")
        assert rows.count() == 0
