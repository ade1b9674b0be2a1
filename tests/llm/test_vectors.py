from __future__ import annotations

import numpy as np
import pytest

from rowrinse.llm import vectors
from tests.llm.test_simhash import closure

SCHEMA = "vec_id bigint, embedding array<float>, label int, cls string, component string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    v = [b for b in base] + [b + rng.standard_normal(16) * 0.12 for b in base[:20] for _ in range(3)] + [base[0]] * 5
    v += [base[1] + rng.standard_normal(16) * 0.03 for _ in range(60)]
    out = [(i, [float(x) for x in np.float32(x)], 0, "x", "y") for i, x in enumerate(v)]
    n = len(out)
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    return out + [(n + k, o, 0, "x", "y") for k, o in enumerate(odd)] + [(None, out[3][1], 0, "x", "y"), out[4]]


def linked(a, b):
    for x in (a, b):
        if not x or any(c is None or not np.isfinite(c) for c in x) or not any(x):
            return False
    if len(a) != len(b):
        return False
    a, b = np.array(a, float), np.array(b, float)
    return bool(a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9)


@pytest.mark.parametrize("shard,few", [(512, 64), (7, 3)])
def test_against_brute_force(spark, rows, monkeypatch, shard, few):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "FEW", few)
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    roots = closure(len(rows), lambda i, j: linked(rows[i][1], rows[j][1]))
    count = [sum(i != j and linked(r[1], q[1]) for j, q in enumerate(rows)) for i, r in enumerate(rows)]
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    wanted = sorted(((r[0], c, least.get(x), r[0] is not None and r[0] == least.get(x)) for r, c, x in zip(rows, count, roots)), key=str)
    found = sorted(map(tuple, got), key=str)
    # the share of links found; what is found is never too much
    assert sum(f[1] for f in found) >= 0.97 * sum(w[1] for w in wanted)
    assert all(f[1] <= w[1] for f, w in zip(found, wanted))
    assert [f[2:] for f in found] == [w[2:] for w in wanted]


def test_theory_matches_the_hashes():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 16))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    same = (vectors.signatures(a, 1, 20) == vectors.signatures(b, 1, 20)).mean()
    assert same == pytest.approx(vectors.collision(np.sqrt(0.2)), abs=0.02)


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
