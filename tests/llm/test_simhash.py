from __future__ import annotations

import random

import numpy as np
import xxhash

from rowrinse.llm import simhash


def brute_fingerprint(text, k=4):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_query_against_brute_force(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = closure(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    wanted = sorted((-1 if r[0] is None else r[0], f, least.get(c)) for r, f, c in zip(rows, fps, roots))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1] % (1 << 64), r[2]) for r in found) == wanted


def test_trees_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    values = np.unique(np.r_[values, values[:150] ^ np.uint64(5), values[:80] ^ np.uint64(1 << 40 | 3)])
    block = np.sort(rng.integers(0, 4, len(values)))
    forest = simhash.Forest(block, values)
    root = forest.roots[np.searchsorted(forest.root_block, block)]
    found = set()
    for who, node in forest.within(values, root, 4):
        found |= set(zip(who.tolist(), node.tolist()))
    near = simhash.distance(values[:, None], values[None, :]) <= 4
    assert found == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near & (block[:, None] == block[None, :]))))}


def test_masks_miss_nothing_within_the_radius():
    rng = random.Random(1)
    for n in (10, 100_000, 10**9):
        masks = simhash.bit_blocks(n, 4)
        for _ in range(200):
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(differ & m == 0 for m in masks)


def test_large_keys_are_cut_into_shards(docs, rows, monkeypatch):
    whole = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    monkeypatch.setattr(simhash, "SHARD", 3)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == whole


def test_similar_texts_against_brute_force(docs, rows):
    sets = [set(simhash.shingles(r[1] or "", 5).tolist()) for r in rows]

    def linked(i, j):
        a, b = sets[i], sets[j]
        return len(a & b) >= 0.8 * len(a | b)

    roots = closure(len(rows), linked)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    wanted = sorted(str(r[0]) for r, root in zip(rows, roots) if r[0] == least.get(root))
    assert sorted(str(r["doc_id"]) for r in simhash.drop_similar(docs).collect()) == wanted


def test_repeated_passages_do_not_move_wide_fingerprints():
    rng = random.Random(5)
    for i in range(20):
        ws = [f"t{i}w{j}" for j in range(404)]
        at = rng.randrange(100, 300)
        passage = ws[at : at + 14]
        plain, repeated = " ".join(ws), " ".join(ws[:at] + passage * 8 + ws[at + 14 :])
        a, b = set(simhash.shingles(plain, 5).tolist()), set(simhash.shingles(repeated, 5).tolist())
        assert len(a & b) >= 0.98 * len(a | b)
        apart = [(x ^ y).bit_count() for x, y in zip(simhash.wide_fingerprint(plain, 5), simhash.wide_fingerprint(repeated, 5))]
        assert max(apart) <= 14


def pairs_at(rng, sizes, share=0.8):
    """Pairs of texts whose shingle sets reach the share by as little as their sizes allow."""
    out = []
    for i, n in enumerate(sizes):
        ws = [f"p{i}x{rng.randrange(10**9)}" for _ in range(n + 4)]
        other = list(ws)
        while True:  # change single words, from the end on, while the share is still reached
            trial = list(other)
            trial[rng.randrange(len(trial)) if n > 40 else -1 - (ws != other)] = f"c{rng.randrange(10**9)}"
            a, b = (set(simhash.shingles(" ".join(t), 5).tolist()) for t in (ws, trial))
            if len(a & b) < share * len(a | b):
                break
            other = trial
        if n < 40:  # a short text against one with one shingle more
            other = ws + ["more"]
        out.append((" ".join(ws), " ".join(other)))
    return out


def test_isolated_pairs_at_the_similarity_are_all_found(spark):
    pairs = pairs_at(random.Random(11), [4, 4, 5, 6, 9, 12] * 4 + list(range(60, 400, 6)))
    for a, b in pairs:
        a, b = (set(simhash.shingles(t, 5).tolist()) for t in (a, b))
        assert len(a & b) >= 0.8 * len(a | b)
    rows = [(2 * i + side, text) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    kept = simhash.drop_similar(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(rows), 2))


def test_starts_and_parities_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n, extra = int(rng.integers(1, 300)), int(rng.integers(0, 40))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        a = np.sort(base[rng.random(len(base)) > 0.08])
        b = np.unique(np.r_[base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
        shared = len(np.intersect1d(a, b))
        if not len(a) or shared < 0.8 * (len(a) + len(b) - shared):
            continue
        common = len(np.intersect1d(simhash.start_of(a, 0.8), simhash.start_of(b, 0.8)))
        assert common >= max(simhash.wanted_start(len(a), 0.8), simhash.wanted_start(len(b), 0.8))
        bits = [simhash.parity(x).tobytes() for x in (a, b)]
        both = np.array([True, True])
        found = simhash.possible_pairs(np.array([len(a), len(b)]), np.array([1, 2]), bits, both, both, 0.8)
        assert any(len(i) for i, _ in found)


def test_choice_of_blocks_does_not_change_what_is_similar(spark, monkeypatch):
    pairs = pairs_at(random.Random(13), [4, 5, 8, *range(80, 320, 12)])
    rows = [(2 * i + side, text) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    # nothing but equal first halves is proposed
    monkeypatch.setattr(simhash, "sampled_blocks", lambda n: [(1 << 64) - 1])
    kept = simhash.drop_similar(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(rows), 2))


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.drop_similar(empty).count() == 0


def test_links_of_a_group_grow_with_its_size(spark, tmp_path):
    """Near copies of one text: one document stays, and the links are about as many as the members."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    counts = {}
    for n in (200, 800):
        rows = []
        for i in range(n):
            words = list(base)
            for at in rng.choice(len(base), 3, replace=False):
                words[at] = f"x{i}y{at}"
            rows.append((i, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        assert [r["doc_id"] for r in simhash.drop_similar(docs).collect()] == [0]
        stages = simhash.Stages(spark)
        members = spark.createDataFrame([(1, i) for i in range(n)], "group bigint, text_hash bigint")
        sets = {i: simhash.shingles(t, 5).tobytes() for i, t in rows}
        sets_of = lambda wanted: wanted.join(spark.createDataFrame([(i, bytearray(s)) for i, s in sets.items()], "text_hash bigint, shingles binary"), "text_hash")
        links = simhash.linked_groups(members, sets_of, 0.8, stages)
        counts[n] = links.count()
        stages.close()
    assert counts[800] <= 1.3 * 800 and counts[200] <= 1.3 * 200


def test_sampled_masks_do_not_multiply_with_the_values():
    """As many keys a text for any number of texts, longer ones for more, and near values still share some."""
    few = simhash.sampled_blocks(1000)
    rng = np.random.default_rng(3)
    for n in (1 << 20, 1 << 21, 1 << 24, 1 << 30):
        masks = simhash.sampled_blocks(n)
        assert len(masks) == len(set(masks)) == len(few) and masks == simhash.sampled_blocks(n)
        assert all(0 < m < 1 << 64 and m.bit_count() >= n.bit_length() - 9 for m in masks)
        met = 0
        for _ in range(200):
            apart = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            met += any(m & apart == 0 for m in masks)
        assert met >= 190


def test_any_masks_give_the_same_components(docs, monkeypatch):
    first = sorted(map(tuple, simhash.similar_documents(docs).collect()))
    monkeypatch.setattr(simhash, "sampled_blocks", lambda n, f=simhash.sampled_blocks: f(1 << 24))
    assert sorted(map(tuple, simhash.similar_documents(docs).collect())) == first


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from rowrinse.llm.common import RELEASED, Stages

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, set_before = files(), spark.conf.get(RELEASED, None)
    stages = Stages(spark)
    out = stages(spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 50 and spark.conf.get(RELEASED, None) == set_before
    stages.close()


def test_exploded_keys_are_never_broadcast(spark):
    """Spark does not multiply a size by an explode; a few MB of fingerprints would be sent as all their keys."""
    values = spark.range(1000).selectExpr("id as node", "id as fp", "id as more")
    plan = simhash.near_links(values, 1000, 14, simhash.sampled_blocks(1000))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_parities_tell_sets_below_the_similarity_apart():
    """Sets that share enough are always possible; of those a little below the similarity few are."""
    rng = np.random.default_rng(5)
    both, left = np.array([True, True]), {0.74: 0, 0.8: 0}
    for similarity in left:
        for _ in range(100):
            every = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
            shared = round(similarity * 200 + 0.499)
            own = (200 - shared) // 2
            a, b = np.r_[every[:shared], every[200 : 200 + own]], np.r_[every[:shared], every[300 : 300 + 200 - shared - own]]
            bits = [simhash.parity(x).tobytes() for x in (a, b)]
            size = np.array([len(a), len(b)])
            left[similarity] += any(len(i) for i, _ in simhash.possible_pairs(size, np.array([1, 2]), bits, both, both, 0.8))
    assert left[0.8] == 100 and left[0.74] <= 20
