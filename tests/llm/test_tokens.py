from __future__ import annotations

import zlib

import numpy as np
import pytest

from rowrinse.llm import tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_tokenizer())


def test_ids_are_the_librarys(encoder, rows):
    texts = [r[1] or "" for r in rows] + ["a<|endoftext|>b", "don't'x !!'", "İΣ ß", "a\x1cb\x85c", "x²y½ 3rd", "µ ÀÉ"]
    ids, sizes = encoder.encode_all(texts)
    ends = np.cumsum(sizes)
    for t, e, s in zip(texts, ends, sizes):
        assert ids[e - s : e].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
@pytest.mark.parametrize("kind", ["same", "cycle", "random", "large"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "same": np.full(n, 49_407), "cycle": np.arange(n) % 7 * 5000, "random": rng.integers(0, 49_408, n),
        "large": rng.integers(0, 1 << 17, n),
    }[kind].astype(np.uint32)
    docs, sizes, back = tokens.unpack(tokens.pack([None, 5, -3], np.array([0, n, 0]), ids, block=64))
    assert docs == [None, 5, -3] and sizes.tolist() == [0, n, 0] and (back == ids).all()


def test_repetition_compresses():
    ids = np.tile(np.random.default_rng(0).integers(0, 49_000, 50), 400).astype(np.uint32)
    assert len(tokens.pack([1], np.array([len(ids)]), ids)) < len(ids) / 2


def test_blocks_are_independent_and_damage_is_found():
    ids = np.arange(300).astype(np.uint32) * 7
    data = bytearray(tokens.pack([1], np.array([300]), ids, block=100))
    data[-1] ^= 1
    data[-20] ^= 255
    with pytest.raises(ValueError, match="block 2"):
        tokens.unpack(bytes(data))


def test_files_against_brute_force(docs, rows, encoder):
    got = sorted((tuple(r) for r in tokens.encode_and_read(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    by_id = {r[0]: r[1] or "" for r in rows}
    start = 0
    for i, at, n, crc in got:
        ids = encoder.tokenizer.encode(by_id[i], add_special_tokens=False).ids + [1]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_empty(empty):
    assert tokens.encode_and_read(empty).count() == 0


def test_words_are_not_looked_up_one_by_one():
    """Texts of usual letters take no call of the library; ids are those of the library with quotes, signs and accents."""
    from rowrinse.llm import tokens

    encoder = tokens.Encoder(tokens.default_tokenizer())
    library = encoder.tokenizer
    texts = ["", " ", "it's 'stuff ,'s don't WE'LL I'd re're '''s 's's x'l", "¿Qué? daß ße ß ¿ naïve÷3", "12²3x µm ªº «q» a­b ñ.\tb\r\nc\x0bd", "!!!...?!a_b {x|y} ~`^", "ÀÉ Ç", "'léa 'rë 'v\n'd9 's9 'll"]
    odd = ["½ þ ýÝ × ÿ", "日本 a", "\x7f a\x01", "<|endoftext|> a", "\x85n"]
    wanted = [[*e.ids, tokens.END] for e in library.encode_batch(texts + odd + texts, add_special_tokens=False)]
    ids, sizes = encoder.encode_all(texts + odd + texts)
    assert [i for w in wanted for i in w] == ids.tolist() and [len(w) for w in wanted] == sizes.tolist()
    encoder.tokenizer = None  # any call fails from here on
    ids, sizes = encoder.encode_all(texts)
    assert ids.tolist() == [i for w in wanted[: len(texts)] for i in w]


@pytest.mark.parametrize("kept", [0, 4 << 20])
def test_each_different_word_is_merged_once(monkeypatch, kept):
    monkeypatch.setattr(tokens, "KNOWN_BYTES", kept)
    encoder = tokens.Encoder(tokens.default_tokenizer())
    fast, merged = encoder.fast, []

    class Counting:
        def encode_to_numpy(self, text):
            merged.append(len(text))
            return fast.encode_to_numpy(text)

    encoder.fast = Counting()
    texts = ["The cat,  the dog; don't ßé 12.", "", " ", "another cat"] * 100
    wanted = [i for t in texts for i in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, tokens.END]]
    for _ in range(2):
        assert encoder.encode_all(texts)[0].tolist() == wanted
    assert sum(merged) < (200 if kept == 0 else 100)


def test_blocks_with_very_different_shares_of_new_ids():
    rng = np.random.default_rng(3)
    parts = [np.full(64, 7), rng.integers(0, 1 << 17, 64), np.arange(64) % 3, rng.integers(0, 1 << 17, 64), np.full(64, 9), rng.integers(0, 300, 5)]
    ids = np.concatenate(parts).astype(np.uint32)
    more = tokens.encode_blocks(ids, 64)[2].tolist()
    assert more[1] == more[3] == 64 and more[0] < 5 and more[4] < 5
    assert (tokens.unpack(tokens.pack([1], np.array([len(ids)]), ids, block=64))[2] == ids).all()
