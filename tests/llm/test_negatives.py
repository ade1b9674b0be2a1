from __future__ import annotations

import math

import numpy as np
import pytest

from rowrinse.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor string, score string, block int"


def make(n=420, dims=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    out = []
    for i in range(n):
        v = centres[i % 6] + rng.standard_normal(dims) * 0.8
        v *= rng.choice([0.02, 0.3, 1.0, 1.1]) / np.linalg.norm(v)
        # labels that cut across the centres, one of them with a third of all rows
        label = 0 if rng.random() < 0.33 else int(rng.integers(1, 5))
        out.append((i, [float(x) for x in np.float32(v)], label, "x", "y", 1))
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims, [1.0] * 3, [1.0, 2.0, 1.0]]
    out += [(1000 + 10 * k, o, k % 2, "x", "y", 1) for k, o in enumerate(odd)]
    out += [(None, out[3][1], 1, "x", "y", 1), (2000, out[3][1], None, "x", "y", 1), out[5], out[5]]
    # ties: copies of one vector under several labels
    out += [(3000 + k, out[7][1], k % 5, "x", "y", 1) for k in range(40)]
    return out


def brute(rows, every=10, positives=5, count=10, least=30, most=90):
    usable = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for a_id, a_label, a in {(i, lab, tuple(v)) for i, lab, v in usable if i % every == 0}:
        scored = [(sum(x * y for x, y in zip(a, v)), i, lab) for i, lab, v in usable if len(v) == len(a)]
        good = sorted((-s, i) for s, i, lab in scored if lab == a_label and i != a_id)[:positives]
        for s, p in ((-s, i) for s, i in good):
            bad = sorted((-t, i) for t, i, lab in scored if lab != a_label and least * s <= 100 * t <= most * s)[:count]
            out += [(a_id, p, r, i, s, -t) for r, (t, i) in enumerate(bad, 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket,block,wave,part", [(512, 32768, 16, 4096), (16, 40, 2, 7)])
def test_against_brute_force(spark, monkeypatch, bucket, block, wave, part):
    rows = make()
    for name, value in (("BUCKET", bucket), ("BLOCK_ROWS", block), ("WAVE", wave), ("ANCHOR_ROWS", part), ("GROWTH", 2)):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = negatives.hard_negatives(df, anchor_every=10)
    got = sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    wanted = brute(rows)
    assert len(wanted) > 300 and got == wanted


def test_ranges_drop_rows_but_none_that_counts():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 32))
    v = np.floor(256 * (base[rng.integers(0, 4, 2000)] + 0.3 * rng.standard_normal((2000, 32)))).astype(np.int64)
    index = negatives.Index(np.arange(2000), v)
    for q in v[:20]:
        floats = q.astype(float)
        length = np.linalg.norm(floats)
        focus = np.argsort(-np.abs(floats))[: negatives.FOCUS].tolist()
        for share in (0.5, 0.8, 0.95):
            kept = 0
            for b in index.buckets:
                wanted = share * length * b.longest
                rows = b.candidates(focus, floats / length, share)
                kept += len(rows)
                assert set(b.rows[v[b.rows] @ q >= wanted]) <= set(rows)
            if share > 0.9:
                assert kept < 1200


def test_exact_beyond_doubles():
    v = np.array([[1 << 40, 3], [1 << 40, 1], [1, 1]], np.int64)
    index = negatives.Index(np.arange(3), v)
    q = np.array([1 << 20, 1], np.int64)
    assert index.scores(np.arange(3), q).tolist() == [(1 << 60) + 3, (1 << 60) + 1, (1 << 20) + 1]


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "", "", 0)], SCHEMA)).count() == 0
