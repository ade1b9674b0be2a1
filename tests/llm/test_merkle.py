from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rowrinse.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, proofs):
    """The root of digests; adds (before, after) of each level to the members' proofs."""
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in held[at + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            over.append([i for h in held[at : at + 8] for i in h])
        nodes, held = up, over
    return nodes[0]


def brute(rows):
    leaf = lambda r, t: H(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(t))
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops, all_proofs = [], {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        all_proofs[name] = [[] for _ in trees[name]]
        tops.append(climb([x[2] for x in trees[name]], all_proofs[name]))
    over = [[] for _ in names]
    root = climb(tops, over)
    out = []
    for name, top, more in zip(names, tops, over):
        for (_, _, digest, r), proof in zip(trees[name], all_proofs[name]):
            steps = proof + more
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1]
            if hit and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r, text) if hit else digest
            for before, after in steps:
                fold = H(before, fold, after)
            out.append((r[0], digest, top, root, H(*[a + b for a, b in steps]), fold, fold == root))
    return sorted(out, key=str)


def found(df):
    out = merkle.manifest(df).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, out.collect()), key=str)


def test_table(docs, rows):
    assert found(docs) == brute(rows)


def test_trees_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(merkle.jumped, "__defaults__", (4,))  # many copies of each ancestor
    rng = random.Random(4)
    rows = []
    for k, n in enumerate([1, 2, 8, 9, 64, 65, 600, 1, 3, 7]):
        rows += [(len(rows) + i, rng.choice(["Text", "text", None, ""]), [None, "de", "en", "zz", "é", "日", "", "a", "b", "B"][k], "s", 4) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(df) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_one_tree(spark, n):
    rows = [(i, "A", "en", None, None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(df) == brute(rows)


def test_single_leaves_only(spark):
    rows = [(i, "A", f"l{i:02d}", None, None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(df) == brute(rows)


def test_empty(empty):
    assert merkle.manifest(empty).count() == 0
