"""Token ids in a compressed binary file format.

A text's ids come from a BPE tokenizer, a batch of texts at a time.
A file holds the ids of a range of documents in order, cut into blocks that
each start afresh and carry a checksum. In a block, three predictions are made
of the next id: the one that last followed the two ids before (order 2), the
one that last followed the id before (order 1), and the block's commonest of
late (order 0). The counts of which of them came true, each kept under its
confidence, are mixed into the odds that drive a range coder. An id that none
foresaw is coded by its class, with the block's counts of four groups and the
four classes of each, and its place in it. These ids have a range coder of
their own, so that each of the two passes does the same for all its blocks.

All blocks of a file are coded side by side, so that each step is a few array
operations over blocks and not a Python loop over ids.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowrinse.llm.common import Stages, held, in_slices, quoted, shared_folder, spread, text_of

MAGIC = b"IDRANGE2"
BLOCK = 2048
END = 1
SLOTS = 2048
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
# Texts that go through the library: beyond Latin-1, special tokens, control characters, and the few whose place
# among the 256 bytes the last bytes of words take.
UNUSUAL = r"<\||[\x00-\x08\x0e-\x1f\x7f\x{80}-\x{9f}½¾ÝÞýþ×]|[^\x{00}-\x{ff}]"
FULL, LEAST, FIELD = (np.uint64(v) for v in ((1 << 64) - 1, 1 << 48, 0xFFFF))
ONE, TWO, FOUR, WORD_BITS, FIRST, TOP, LAST_FIELD = (np.uint64(v) for v in (1, 2, 4, 16, 16, 48, 48))
ONES = np.uint64(0x0001_0001_0001_0001)
# What a count gains: seven times a block's gains, mixed, stay below 2^16. A group, a class and a place take
# 2^40 of the range at most, since what is rare among the groups has had few classes counted.
GAIN, MORE = np.uint64(4), np.uint64(1)
# Ids by classes of growing width, powers of two: 16 classes, in four groups, over ids up to 2^17.
WIDTH_BITS = np.array([9, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 16], np.uint64)
EDGES = np.r_[0, np.cumsum(1 << WIDTH_BITS.astype(np.int64))]
KIND = np.repeat(np.arange(16, dtype=np.uint8), np.diff(EDGES))
# What a share of a range is rounded down to.
ROUND = np.uint64(12)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _shown() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


UNSHOWN = _shown()
# How the last byte of a word is written, so that it differs from all bytes inside of words: capital letters, control
# characters for signs, other second bytes of a character; digits are words by themselves. Texts are lower-cased.
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
LAST_BYTE = {b: b - 32 for b in range(0x61, 0x7B)} | {b: b for b in range(0x30, 0x3A)} | {b: k for k, b in enumerate(SIGNS)}
LAST_BYTE |= {b: b - 32 for b in range(0xA0, 0xBD)} | {0x9F: 0x9D, 0xBF: 0x9E}
# The mark behind each text, and the id it gets.
STOP, STOP_ID = 0x7F, 1 << 17


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the 256 Latin-1 characters: lower case, how each is written at the end of a word, and its class."""
    lower = np.array([ord(chr(c).lower()) if chr(c).lower() < "\u0100" else c for c in range(256)], np.uint8)
    last = np.arange(256, dtype=np.uint8)
    for c in range(256):
        raw = chr(c).encode()
        if c < 0x80:
            last[c] = LAST_BYTE.get(c, c)
        elif c >= 0xA0 and raw[-1] in LAST_BYTE and chr(c) == chr(c).lower():
            last[c] = ord(bytes([raw[0], LAST_BYTE[raw[-1]]]).decode())
    kind = np.zeros(256, np.uint8)
    for c in range(256):
        if WORD.fullmatch(chr(c)):
            kind[c] = 1 if re.fullmatch("[a-zªµºß-öø-ÿ]", chr(c)) else 2 if re.fullmatch("[0-9²³¹¼½¾]", chr(c)) else 3
    kind[STOP] = 4
    lower[kind.take(lower) == 0] = 0x20
    return lower, last, kind


LOWER, LAST, KIND_OF = _tables()
# Whether a character of one class ends a word before one of another, by 8 * class + next class; a mark ends one too.
ENDS_WORD = np.array([0 < a and (a != b or a in (2, 4)) for a in range(8) for b in range(8)])
# The same as tables for ``bytes.translate``, which is many times faster than indexing by bytes.
TO_LOWER, TO_KIND, TO_END = LOWER.tobytes(), KIND_OF.tobytes(), ENDS_WORD.tobytes().ljust(256, b"\0")


# Bytes of words whose ids an encoder keeps, with 8 for each word.
KNOWN_BYTES = 4 << 20


class Encoder:
    """Ids of texts, equal to those of the tokenizers library for the whole text.

    Words and their last characters are found for all texts of a batch at
    once, in arrays of Latin-1 characters. The last character of a word is
    rewritten (``LAST_BYTE``), so that tokens that end words are tokens of
    bytes like any other and tiktoken merges them by the same ranks. Each
    different word of a batch is merged once, and its ids are copied to where
    it stands; the first ``KNOWN_BYTES`` of words are kept for later batches.
    Other texts go through the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.known = model.get("end_of_word_suffix") == "</w>"  # files of another kind go through the library
        vocab = model["vocab"] if self.known else {}
        ranks = {}
        for token, i in vocab.items():
            bare = token.removesuffix("</w>")
            raw, last = bytes(UNSHOWN[c] for c in bare), bare != token
            # what no lower-cased Latin-1 word holds is left out
            if raw and all(b in LAST_BYTE or b in (0xC2, 0xC3) for b in raw) and not (last and raw[-1] in (0xC2, 0xC3)):
                ranks[raw[:-1] + bytes([LAST_BYTE[raw[-1]]]) if last else raw] = i
        # every byte must have a rank, those that never come as well
        ranks |= {bytes([b]): STOP_ID + 1 + b for b in range(256) if bytes([b]) not in ranks} | {bytes([STOP]): STOP_ID}
        ends = "".join(f"\\x{{{c:x}}}" for c in sorted(set(LAST[(KIND_OF > 0) & (KIND_OF < 4)].tolist())))
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{ends} \\x7f]*[{ends}]|\\x7f", mergeable_ranks=ranks, special_tokens={})
        # which ids end a word
        last = {STOP, *LAST_BYTE.values()}
        self.closes = np.zeros(max(ranks.values()) + 1, bool)
        self.closes[[i for raw, i in ranks.items() if raw[-1] in last]] = True
        # words kept, all their ids in a row, and where each word's end there
        self.words, self.ids, self.upto = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts by the library alone, and the number of each text's."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts, the last character of each word rewritten and ``STOP`` behind each text, and where words end."""
        raw = bytearray(("\x7f".join(texts) + "\x7f").encode("latin-1")).translate(TO_LOWER)
        kind = np.frombuffer(raw.translate(TO_KIND), np.uint8)
        raw = np.frombuffer(raw, np.uint8)
        pair = kind << 3
        pair[:-1] |= kind[1:]
        last = np.frombuffer(bytearray(pair).translate(TO_END), bool)
        # 's and the like, where no sign stands before the quote; the last character of all is a mark
        quote = np.flatnonzero(raw == 0x27)
        quote = quote[(kind.take(quote + 1) == 1) & ((quote == 0) | (kind.take(quote - 1) != 3))]
        if len(quote):
            one, two = (raw.take(quote + k, mode="clip") for k in (1, 2))
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            last[quote[short | long]] = False
            last[quote[short] + 1] = True
            last[quote[long] + 2] = True
        ends = np.flatnonzero(last)
        raw[ends] = LAST.take(raw.take(ends))
        return raw, ends

    def merged(self, texts: list[str]) -> np.ndarray:
        """The ids of the texts, ``STOP_ID`` behind each; a word goes with the spaces before it, which have no ids."""
        raw, ends = self.marked(texts)
        spans = [None, pa.py_buffer(np.r_[0, ends + 1]), pa.py_buffer(raw)]
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), spans).dictionary_encode()
        which, words = words.indices.to_numpy(), words.dictionary
        place = pc.index_in(words, value_set=self.words)
        unknown = np.asarray(place.is_null())
        place = place.fill_null(0).to_numpy().astype(np.int64)
        place[unknown] = len(self.words) + np.arange(np.count_nonzero(unknown))
        words = words.filter(pa.array(unknown))
        size = int(np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)[-1])
        found = self.fast.encode_to_numpy(words.buffers()[2].slice(0, size).to_pybytes().decode("latin-1")) if size else self.ids[:0]
        upto = np.r_[self.upto, np.flatnonzero(self.closes.take(found)) + 1 + len(self.ids)]
        found = np.r_[self.ids, found]
        if self.words.nbytes + words.nbytes <= KNOWN_BYTES:
            self.words, self.ids, self.upto = pa.concat_arrays([self.words, words]), found, upto
        counts = np.diff(upto, prepend=0)
        which = place.take(which)
        begin, counts = (upto - counts).take(which), counts.take(which)
        past = np.cumsum(counts)
        return found.take(np.arange(past[-1]) + np.repeat(begin - past + counts, counts))

    def encode_all(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, an end id after each text, and the number of each text's."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        apart = np.asarray(pc.match_substring_regex(texts, UNUSUAL), bool) if self.known else np.ones(len(texts), bool)
        if apart.any():
            texts, odd = pc.if_else(pa.array(apart), "", texts), texts.filter(pa.array(apart)).to_pylist()
        ids = self.merged(texts.to_pylist()) if len(texts) else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == STOP_ID)
        sizes = np.diff(np.r_[-1, ends])
        out = ids.astype(np.uint32)
        out[ends] = END
        if apart.any():
            more, counts = self.whole(odd)
            out = np.insert(out, np.repeat(ends[apart], counts), more)
            sizes[apart] += counts
        return out, sizes


def _pick(mask: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``one`` where all bits of ``mask`` are set, ``other`` where none is; several times faster than ``np.where``."""
    return other ^ ((one ^ other) & mask)


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, copied a few rows at a time, so that what is read and written stays near."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for k in range(0, len(rows), 16):
        out[:, k : k + 16] = rows[k : k + 16].T
    return out


class Predictor:
    """The model's state in every block: predictions, and the counts that mix them.

    Four counts of 16 bits lie side by side in one number, so that they are
    added, and summed up (by a product with ``ONES``), together.
    """

    def __init__(self, lanes: int):
        self.slot, self.row = np.arange(lanes) * SLOTS, np.arange(lanes) * 8
        self.before, self.last, self.zero = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int32)
        # id * 8 + confidence, under a hash of the context
        self.two, self.one = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)
        self.by = [np.full(lanes * 8, ONES) for _ in range(3)]

    def shrink(self, lanes: int) -> None:
        """Blocks of full length come first; shorter ones end and leave."""
        for name in ("slot", "row", "before", "last", "zero"):
            setattr(self, name, getattr(self, name)[:lanes])

    def predict(self) -> np.ndarray:
        """The mixed counts of: order 2 is right, order 1, order 0, none. Sets the three guesses."""
        spun = self.last * 0x9E3779B1
        self.at_two = self.slot + ((self.before * 0x85EBCA77 + spun >> 12) & (SLOTS - 1))
        self.at_one = self.slot + ((spun >> 11) & (SLOTS - 1))
        self.seen = self.two.take(self.at_two), self.one.take(self.at_one), self.zero
        self.conf = [v & 7 for v in self.seen]
        self.guess = [v >> 3 for v in self.seen]
        self.at = [self.row + c for c in self.conf]
        self.counts = [t.take(a) for t, a in zip(self.by, self.at)]
        two, one, zero = self.counts
        return (two << TWO) + (one << ONE) + zero

    def learn(self, ids: np.ndarray, missed: list[np.ndarray], shift: np.ndarray) -> None:
        """``missed`` tells of each guess whether it was wrong, ``shift`` is 16 times the number of what came true.

        A guess that is right gains confidence up to 7; one that is wrong loses
        some, or gives way to the id.
        """
        plus = GAIN << shift
        for table, at, counts in zip(self.by, self.at, self.counts):
            table[at] = counts + plus
        fresh = ids << 3 | 1
        after = []
        for seen, c, wrong, step in zip(self.seen, self.conf, missed, (2, 2, 1)):
            wrong = -wrong.view(np.int8).astype(np.int32)  # all bits, or none; so is a number below 0 shifted by 31
            kept = seen - _pick(wrong, np.int32(step), (c - 7) >> 31)
            after.append(_pick(wrong & ((c - step) >> 31), fresh, kept))
        self.two[self.at_two], self.one[self.at_one], self.zero = after
        self.before, self.last = self.last, ids.astype(np.int64)


def _lanes(counts: np.ndarray) -> list[tuple[int, int]]:
    """(step, blocks alive) at each step where blocks end; ``counts`` is falling."""
    return [(int(c), int((counts > c).sum())) for c in np.unique(counts)[:-1]]


def _part(packed: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and total of one of four counts side by side."""
    upto = packed * ONES
    return (upto << WORD_BITS) >> shift & FIELD, packed >> shift & FIELD, upto >> LAST_FIELD


def _share(span: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``span // total`` but for the last 12 bits: by doubles, which hold the other 52 exactly and divide twice as fast."""
    return ((span >> ROUND).view(np.int64) / total.view(np.int64)).astype(np.int64).view(np.uint64) << ROUND


def _which(packed: np.ndarray, value: np.ndarray, r: np.ndarray) -> np.ndarray:
    """16 times the number of the count among four, each ``r`` wide, that a value falls into."""
    upto = packed * ONES
    one, two, three = ((value >= r * (upto >> np.uint64(k) & FIELD)).view(np.uint8) for k in (0, 16, 32))
    return (one + two + three).astype(np.uint64) << FOUR


class Writer:
    """The range coders of blocks; word k of all blocks lies side by side, since blocks are at about the same word."""

    def __init__(self, lanes: int, steps: int):
        self.lanes, self.height = lanes, 4 * steps + 8
        self.out, self.at = np.zeros(self.height * lanes, np.uint16), np.arange(lanes)
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, FULL)

    def narrow(self, a: np.ndarray, s: np.ndarray) -> None:
        """The first blocks' ranges become a .. a + s; words that are settled are written."""
        out, at, lanes = self.out, self.at, self.lanes
        carry = at[np.flatnonzero(a < self.low[: len(a)])] - lanes  # the sum went round
        while len(carry):
            out[carry] += 1
            carry = carry[out[carry] == 0] - lanes
        short = np.flatnonzero(s < LEAST)
        while len(short):
            lower, size, here = a[short], s[short] << WORD_BITS, at[short]
            out[here] = lower >> TOP
            at[short] = here + lanes
            a[short], s[short] = lower << WORD_BITS, size
            short = short[size < LEAST]
        self.low[: len(a)], self.span[: len(a)] = a, s

    def words(self) -> list[np.ndarray]:
        """What is left of the lower ends is written; the words of each block."""
        for _ in range(4):
            self.out[self.at] = self.low >> TOP
            self.low = self.low << WORD_BITS
            self.at += self.lanes
        lengths = (self.at // max(1, self.lanes)).tolist()
        rows = _turned(self.out.reshape(self.height, self.lanes)[: max(lengths, default=0)])
        return [rows[k, :length] for k, length in enumerate(lengths)]


class Reader:
    """The other side of :class:`Writer`: where each block's code lies in its range, and how wide that is."""

    def __init__(self, words: list[np.ndarray]):
        self.lanes = lanes = len(words)
        data = np.zeros((lanes, max(map(len, words), default=0) + 4), np.uint16)
        for k, w in enumerate(words):
            data[k, : len(w)] = w
        data = _turned(data)
        first = data[:4].astype(np.uint64)
        self.code = first[0] << TOP | first[1] << np.uint64(32) | first[2] << WORD_BITS | first[3]
        self.data, self.at, self.span = data.ravel(), np.arange(lanes) + 4 * lanes, np.full(lanes, FULL)

    def narrow(self, a: np.ndarray, s: np.ndarray) -> None:
        short = np.flatnonzero(s < LEAST)
        while len(short):
            here, size = self.at[short], s[short] << WORD_BITS
            a[short] = a[short] << WORD_BITS | self.data.take(here, mode="clip").astype(np.uint64)
            self.at[short] = here + self.lanes
            s[short] = size
            short = short[size < LEAST]
        self.code[: len(a)], self.span[: len(a)] = a, s


def _by_length(counts: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """Blocks by falling counts, and how many are alive from each step on where some end."""
    order = np.argsort(-counts, kind="stable")
    return order, dict(_lanes(counts[order]))


def encode_new(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The code words of each block's ids that none foresaw; ``ids`` has those of all blocks in a row."""
    order, ends = _by_length(counts)
    table = np.zeros((len(counts), int(counts.max(initial=0))), np.int32)
    table[np.arange(table.shape[1]) < counts[:, None]] = ids
    table = _turned(table[order])
    lanes = alive = len(counts)
    writer = Writer(lanes, len(table))
    groups, members, row = np.full(lanes, ONES), np.full(lanes * 4, ONES), np.arange(lanes) * 4
    for step in range(len(table)):
        alive = ends.get(step, alive)
        now = table[step, :alive].astype(np.int64)
        kind = KIND.take(now).astype(np.int64)
        group = kind >> 2
        a, s = writer.low[:alive], writer.span[:alive]
        where = row[:alive] + group
        for tally, at, key in ((groups, slice(alive), group), (members, where, kind & 3)):
            packed, key = tally[at], key.astype(np.uint64) << FOUR
            start, freq, total = _part(packed, key)
            r = _share(s, total)
            a, s = a + r * start, r * freq
            tally[at] = packed + (MORE << key)
        s = s >> WIDTH_BITS.take(kind)
        writer.narrow(a + s * (now - EDGES.take(kind)).astype(np.uint64), s)
    words = writer.words()
    return [words[k] for k in np.argsort(order).tolist()]


def decode_new(counts: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The ids that :func:`encode_new` coded, a column per block."""
    order, ends = _by_length(counts)
    lanes = alive = len(counts)
    reader = Reader([words[k] for k in order.tolist()])
    table = np.zeros((int(counts.max(initial=0)), lanes), np.int32)
    groups, members, row = np.full(lanes, ONES), np.full(lanes * 4, ONES), np.arange(lanes) * 4
    for step in range(len(table)):
        alive = ends.get(step, alive)
        a, s, at, kind = reader.code[:alive], reader.span[:alive], slice(alive), 0
        for tally in (groups, members):
            packed = tally[at]
            r = _share(s, packed * ONES >> LAST_FIELD)
            key = _which(packed, a, r)
            start, freq, _ = _part(packed, key)
            a, s = a - r * start, r * freq
            tally[at] = packed + (MORE << key)
            kind = kind * 4 + (key >> FOUR).astype(np.int64)
            at = row[:alive] + kind
        s = s >> WIDTH_BITS.take(kind)
        place = a // s
        table[step, :alive] = EDGES.take(kind) + place.astype(np.int64)
        reader.narrow(a - s * place, s)
    return table.take(np.argsort(order), axis=1)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Ids per block and the code words (16 bits each) of what came true; of ids that none foresaw the number and words."""
    if block > BLOCK:
        raise ValueError(f"blocks hold up to {BLOCK} ids")
    n = len(ids)
    lanes = -(-n // block)
    counts = np.full(lanes, block)
    if n % block:
        counts[-1] = n % block
    table = np.zeros((lanes, block), np.int32)
    table.ravel()[:n] = ids
    table = _turned(table)
    steps = int(counts.max(initial=0))
    new = np.zeros((block, lanes), bool)
    writer, model, ends, alive = Writer(lanes, steps), Predictor(lanes), dict(_lanes(counts)), lanes
    for step in range(steps):
        if step in ends:
            alive = ends[step]
            model.shrink(alive)
        now = table[step, :alive]
        odds = model.predict()
        missed = [g != now for g in model.guess]
        not_two = missed[0]
        not_one = not_two & missed[1]
        none = not_one & missed[2]
        shift = (not_two.view(np.uint8) + not_one.view(np.uint8) + none.view(np.uint8)).astype(np.uint64) << FOUR
        start, freq, total = _part(odds, shift)
        r = _share(writer.span[:alive], total)
        writer.narrow(writer.low[:alive] + r * start, r * freq)
        model.learn(now, missed, shift)
        new[step, :alive] = none
    del table, model
    new = _turned(new)
    more = new.sum(axis=1)
    words = writer.words()
    return counts, words, more, encode_new(ids[new.ravel()[:n]], more)


def decode_blocks(counts: np.ndarray, words: list[np.ndarray], more: np.ndarray, more_words: list[np.ndarray]) -> list[np.ndarray]:
    """The ids of blocks; only the last may be shorter than the others."""
    lanes, steps = len(counts), int(np.max(counts, initial=0))
    fresh = decode_new(more, more_words)
    fresh, following = fresh.ravel() if fresh.size else np.zeros(1, np.int32), np.arange(lanes)
    out = np.zeros((steps, lanes), np.int32)
    reader, model, ends, alive = Reader(words), Predictor(lanes), dict(_lanes(np.asarray(counts))), lanes
    for step in range(steps):
        if step in ends:
            alive = ends[step]
            model.shrink(alive)
        packed = model.predict()
        a, s = reader.code[:alive], reader.span[:alive]
        r = _share(s, packed * ONES >> LAST_FIELD)
        shift = _which(packed, a, r)
        start, freq, _ = _part(packed, shift)
        reader.narrow(a - r * start, r * freq)
        two, one, zero = model.guess
        new, here = shift == LAST_FIELD, following[:alive]
        ids = np.where(new, fresh.take(here, mode="clip"), np.where(shift == 0, two, np.where(shift == FIRST, one, zero)))
        here += new * np.int64(lanes)
        out[step, :alive] = ids
        model.learn(ids, [g != ids for g in model.guess], shift)
    del model, reader, fresh
    out = _turned(out).view(np.uint32)
    return [out[k, : counts[k]] for k in range(lanes)]


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file: magic, counts, the documents' ids and sizes, a row per block, checksum of all that, code words.

    A block's row: ids, words, ids that none foresaw, their words, checksum.
    """
    if len(ids) and int(ids.max()) >= EDGES[-1]:
        raise ValueError("an id is beyond the format's classes")
    counts, words, more, more_words = encode_blocks(ids, block)
    sums = [zlib.crc32(ids[k * block : k * block + c].astype("<u4").tobytes()) for k, c in enumerate(counts)]
    head = MAGIC + struct.pack("<QQI", len(doc_ids), len(ids), len(counts))
    head += np.array([d is not None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    head += np.asarray(sizes, "<u4").tobytes()
    rows = [[c, len(w), m, len(v), s] for c, w, m, v, s in zip(counts, words, more, more_words, sums)]
    head += np.array(rows, "<u4").reshape(-1, 5).tobytes()
    both = itertools.chain.from_iterable(zip(words, more_words))
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(w.astype("<u2").tobytes() for w in both)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, sizes and all ids of a file, each block held against its checksum."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, total, blocks = struct.unpack_from("<QQI", data, 8)
    at = 28
    real = np.frombuffer(data, np.uint8, n, at)
    doc_ids = np.frombuffer(data, "<i8", n, at + n)
    sizes = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
    rows = np.frombuffer(data, "<u4", 5 * blocks, at + 13 * n).reshape(-1, 5).astype(np.int64)
    at += 13 * n + 20 * blocks
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the head of a token file is damaged")
    lengths = rows[:, [1, 3]].ravel()
    words = np.split(np.frombuffer(data, "<u2", int(lengths.sum()), at + 4), np.cumsum(lengths)[:-1]) if blocks else []
    found = decode_blocks(rows[:, 0], words[::2], rows[:, 2], words[1::2])
    for k, (ids, wanted) in enumerate(zip(found, rows[:, 4])):
        if zlib.crc32(ids.astype("<u4").tobytes()) != wanted:
            raise ValueError(f"block {k} of a token file is damaged")
    ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
    assert len(ids) == total
    return [int(d) if r else None for d, r in zip(doc_ids, real)], sizes, ids


def _fs(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


FILE_BYTES = 32 << 20
FILE_IDS = 16_000_000


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending id order; returns a row (task, part, name, n_ids) per file.

    A null text has the end id alone. Null ids come first; rows with one id
    follow one another by a hash of their text. Files have names of their own,
    so a repeated task leaves none that counts.
    """
    spark = docs.sparkSession
    model = tokenizer or default_tokenizer()
    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), text_of(docs, text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    size = docs.select(F.sum(F.octet_length(quoted(text_col).cast("string")))).first()[0] or 0
    tasks = max(1, -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(tasks, "id", "h").sortWithinPartitions("id", "h").select(
        "id", "text", F.spark_partition_id().alias("task"))

    def save(batches):
        encoder = held(("tokens", model), lambda: Encoder(model))
        fs, folder = _fs(path)
        fs.create_dir(folder, recursive=True)
        state = {"docs": [], "sizes": [], "ids": [], "n": 0, "part": 0, "task": 0}

        def flush():
            ids = np.concatenate(state["ids"]) if state["ids"] else np.zeros(0, np.uint32)
            name = f"tokens-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(pack(state["docs"], np.concatenate(state["sizes"]), ids))
            row = pa.RecordBatch.from_arrays(
                [pa.array([state["task"]], pa.int32()), pa.array([state["part"]], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64())],
                ["task", "part", "name", "n_ids"])
            state.update(docs=[], sizes=[], ids=[], n=0, part=state["part"] + 1)
            return row

        for b in in_slices(batches, 2048):
            if not b.num_rows:
                continue
            state["task"] = b["task"][0].as_py()
            ids, sizes = encoder.encode_all(b["text"])
            state["docs"] += b["id"].to_pylist()
            state["sizes"].append(sizes), state["ids"].append(ids)
            state["n"] += len(ids)
            if state["n"] > FILE_IDS:
                yield flush()
        if state["docs"]:
            yield flush()

    return rows.mapInArrow(save, "task int, part int, name string, n_ids bigint")


def read_tokens(files: DataFrame, path: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of the documents in the files listed by :func:`write_tokens`."""
    order = W.orderBy("task", "part").rowsBetween(W.unboundedPreceding, -1)
    listed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    n = max(1, files.count())
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batches):
        fs, folder = _fs(path)
        for b in batches:
            for name, base in zip(b["name"].to_pylist(), b["base"].to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as file:
                    docs, sizes, ids = unpack(file.read())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(base + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], schema=schema)

    return listed.repartition(n, "name").select("name", "base").mapInArrow(load, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_and_read(docs: DataFrame, **options) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens"
    files = Stages(spark)(write_tokens(docs, path, **options))
    return read_tokens(files, path)
