from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from rowrinse.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def best_fit(lengths, capacity, limit):
    """Plain lists: the tightest open bin that fits, the one filled last among equals; the fullest closes first."""
    free, stamp, opened, out = {}, {}, 0, []
    for clock, n in enumerate(lengths):
        fits = [b for b in free if free[b] >= n]
        if fits:
            b = min(fits, key=lambda x: (free[x], -stamp[x]))
        else:
            if len(free) == limit:
                del free[min(free, key=lambda x: (free[x], -stamp[x]))]
            b, opened = opened, opened + 1
            free[b] = capacity
        out.append((b, capacity - free[b]))
        free[b] -= n
        stamp[b] = clock
        if not free[b]:
            del free[b]
    return out


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_bitset_follows_plain_best_fit(limit):
    rng = random.Random(limit)
    lengths = [rng.randint(1, 40) for _ in range(400)] + [40, 40, 1]
    bins = packing.OpenBins(40, limit)
    assert [bins.place(n) for n in lengths] == best_fit(lengths, 40, limit)


def check(found, capacity):
    """No gap, no overlap, nothing over the capacity; returns the number of sequences."""
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_against_whole_texts(docs, rows, tokenizer, capacity):
    packed = packing.pack_documents(docs, capacity=capacity, with_ids=True)
    found = packed.collect()
    wanted = []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            wanted.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    total = sum(r["length"] for r in found)
    assert check(found, capacity) <= -(-total // capacity) * 1.03 + 2
    by = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in found:
        assert by[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(len(r["ids"]) for r in by.values()) == total


def test_long_texts_in_parts(tokenizer, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word", " ", "  ", "\n", "é", "9", "'s", " a b", " ", "<|endoftext|>"]) for _ in range(3000)) for _ in range(4)]
    texts += ["x" * 5000, " " * 5000 + "a", "\x85" * 300, "\u3000 " * 200_000, "<|endoftext|><|end", ""]
    monkeypatch.setattr(packing.parts_of, "__defaults__", (50,))
    assert max(len(packing.parts_of(t)) for t in texts) > 20
    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.fast
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    encoder.fast = None
    assert [x.tolist() for x in encoder.encode(texts[:2])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts[:2]]


def test_equal_ids_on_the_table(spark, tokenizer):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    found = packing.Encoder(packing.default_tokenizer()).encode(texts)
    assert [x.tolist() for x in found] == [[*e.ids, 0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_files_use_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.ranks_of(path) is None
    encoder = packing.Encoder(path)
    assert encoder.encode(["Some words"])[0].tolist() == [*encoder.library.encode("Some words", add_special_tokens=False).ids, 0]


def test_several_shares_and_copies(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 100)
    docs = spark.createDataFrame([(None, "one two three four")] * 500 + [(i, "five six " * (i % 90)) for i in range(500)], "doc_id bigint, text string")
    found = packing.pack_documents(docs, capacity=128).collect()
    assert len({r["sequence_id"] >> 32 for r in found}) > 5
    assert sum(r["id"] is None for r in found) == 500
    assert check(found, 128) <= 1.1 * sum(r["length"] for r in found) / 128


def test_fill_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.pack_documents(docs).collect()
    assert check(found, 2048) <= 1.005 * sum(r["length"] for r in found) / 2048 + 1


def test_empty(empty):
    assert packing.pack_documents(empty).count() == 0
