from __future__ import annotations

import hashlib
from collections import Counter

from rowrinse.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(docs, rows):
    for length in (64, 400):
        wanted = sorted((r[0] if r[0] is not None else -1, *x) for r, x in zip(rows, brute([r[1] for r in rows], length)))
        got = suffixes.repeats(docs, length=length).collect()
        assert sorted((r[0] if r[0] is not None else -1, *r[1:5]) for r in got) == wanted
        assert all(len(r.kept_text.encode()) <= r.n_bytes - r.n_removed for r in got)
        plain = [r for r in got if r.n_removed == 0 or len(r.kept_text.encode()) == r.n_bytes - r.n_removed]
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in plain)


def test_hot_ranks_and_texts(spark, monkeypatch):
    # one passage, and one text, in most rows: every join takes its salted way
    monkeypatch.setattr(suffixes, "SALTS", 4)
    passage, copy = "shared passage " * 40, "the same text in many rows " * 20
    texts = [f"{i} {i * i} " * 9 + passage + f" {i * 7} {i}" * 9 for i in range(60)] + [copy] * 60 + ["short", "", None]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    found = sorted(tuple(r[:5]) for r in suffixes.repeats(data).collect())
    assert found == [(i, *x) for i, x in enumerate(brute(texts, 400))]
    kept = {r.doc_id: r.text for r in suffixes.drop_repeats(data).collect()}
    assert all(kept[i] == "" for i in range(60, 120)) and kept[120] == "short" and kept[122] is None


def test_pieces_of_a_long_text_do_not_matter(monkeypatch):
    data = b"".join(bytes([65 + i * i % 23]) for i in range(3000))
    whole = suffixes.anchors(data)
    starts = sum(int(b - a + 1) for a, b in zip(*whole[:2]))
    assert starts == len(data) - 399


def test_dropping_keeps_rows_and_columns(docs, rows):
    out = suffixes.drop_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    short = [r for r in got if r["text"] is None]
    assert len(short) == 1
    assert any(r["text"] == "" and r["n_chars"] == 0 and r["doc_id"] == 5 for r in got)


def test_empty(empty):
    assert suffixes.repeats(empty).count() == 0 and suffixes.drop_repeats(empty).count() == 0


def test_salted_keys_are_never_broadcast(spark):
    """A key table of a few MB is some 20 times as much in the driver."""
    rows = spark.range(1000).selectExpr("id % 50 as half", "id as pick")
    others, hot = spark.range(50).selectExpr("id as half"), spark.range(2).selectExpr("id as half")
    out = suffixes.salted(rows, others, ["half"], hot, "left_semi", ["pick"])
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "LeftSemi" in x]
    assert joins and all("SortMergeJoin" in x for x in joins) and out.count() == 1000
