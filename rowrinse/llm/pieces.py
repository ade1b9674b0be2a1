"""SentencePiece encoding as a max-plus scan, and decoding.

A text's segmentation is the best-scoring path over its characters. A long
text is cut into chunks. What a chunk does to a path is a matrix in the
max-plus algebra: entry (i, j) is the best score of a path that enters after
the i-th character of the chunk (the first i belong to a piece that began
before it) and leaves with a piece that reaches j characters into the next.
Matrices combine associatively, so the states at all cuts come from products
of blocks of chunks; then every chunk is traced back by itself.

Where no piece can span a place (before a word mark that follows other
characters), all paths meet. Between two such places a segmentation depends on
the word alone and is looked up; a matrix is then the sum of a column for the
chunk's first word and a row for its last.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import Stages, held, in_slices, partitions, quoted, spread, text_of

MARK = "▁"
CHUNK = 32_768
BLOCK = 256
TOGETHER = 16_384
REMEMBERED = 100_000
# Texts that are cut into words one by one: empty, with a word mark of their own, or with spaces that are not single.
APART = f"^$|^ | $|  |{MARK}"
SHORT = 40
HASH = np.uint64(0x9E3779B97F4A7C15)
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NONE = -np.inf
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def slot(hashes: np.ndarray) -> np.ndarray:
    """Places in the bit table."""
    return ((hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def roomy(array: np.ndarray, size: int) -> np.ndarray:
    """The array, grown so that its last axis has ``size`` places."""
    if array.shape[-1] >= size:
        return array
    out = np.zeros((*array.shape[:-1], max(size, 2 * array.shape[-1])), array.dtype)
    out[..., : array.shape[-1]] = array
    return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces and scores of a model file, read as a unigram model.

    Characters that no piece covers become byte pieces where the model has
    them, else the unknown piece.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.score, self.id = {}, {}
        for i, p in enumerate(proto.pieces):
            if p.type in (NORMAL, USER):
                self.id[p.piece], self.score[p.piece] = i, p.score
        usual = [p.score for p in proto.pieces if p.type == NORMAL]
        for p in proto.pieces:
            if p.type == USER:
                self.score[p.piece] = len(p.piece.encode()) * max(usual, default=0.0) - 0.1
        self.lowest = min(usual, default=0.0) - UNKNOWN_PENALTY
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.kinds = kinds
        self.longest = max(map(len, self.id), default=1)
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        # by first character: the lengths its pieces have
        lengths: dict[str, set[int]] = {}
        for piece in self.id:
            lengths.setdefault(piece[0], set()).add(len(piece))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.words_apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.raw = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, kinds)
        ]
        self._index()

    def _index(self) -> None:
        """Pieces by hash, with a bit table in front, for looking up many stretches at once."""
        names = list(self.id)
        self.power = np.ones(self.longest + 1, np.uint64)
        for n in range(self.longest):
            self.power[n + 1 :] *= HASH
        hashes = np.zeros(len(names), np.uint64)
        for i, name in enumerate(names):
            h = 0
            for c in name:
                h = (h * int(HASH) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hash_id = np.array([self.id[names[i]] for i in order], np.int32)
        self.hash_score = np.array([self.score[names[i]] for i in order], np.float64)
        self.hash_length = np.array([len(names[i]) for i in order], np.int64)
        # most pieces have a slot to themselves; the others are found by searching
        slots = slot(self.hashes)
        self.at = np.full(1 << 20, -1, np.int32)
        self.at[slots] = np.arange(len(names))
        self.crowded = bool((self.at[slots] != np.arange(len(names))).any())
        self.number: dict[str, int] = {}
        self.stored, self.store, self.store_at = 0, np.zeros(1 << 20, np.int32), np.zeros((2, 1 << 18), np.int64)
        self.byte_id = np.array([self.bytes.get(b, self.unknown) for b in range(128)], np.int32)

    def find(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``hashes`` a piece of that length stands, and its number in the index."""
        found = self.at[slot(hashes)]
        maybe = np.flatnonzero(found >= 0)
        at, wanted = found[maybe], hashes[maybe]
        other = np.flatnonzero(self.hashes[at] != wanted)
        if len(other) and self.crowded:
            at[other] = np.minimum(np.searchsorted(self.hashes, wanted[other]), len(self.hashes) - 1)
        sure = (self.hashes[at] == wanted) & (self.hash_length[at] == length)
        return maybe[sure], at[sure]

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of many short words at once: all ids in a row, ids per word, score per word."""
        ids, counts, scores = [], np.zeros(len(words), np.int64), np.zeros(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(words), TOGETHER):
            here = order[at : at + TOGETHER]
            single = size[here] > SHORT
            for k in here[single]:
                found, scores[k] = self.best(words[k])
                parts.append((np.array([k]), np.array(found, np.int32)))
                counts[k] = len(found)
            here = here[~single]
            if len(here):
                owner, found, total, odd = self._together([words[k] for k in here], size[here])
                counts[here], scores[here] = np.bincount(owner, minlength=len(here)), total
                parts.append((here[owner], found))
                for k in here[odd]:  # with characters that take several byte pieces
                    found, _ = self.best(words[k])
                    parts.append((np.full(len(found), k), np.array(found, np.int32)))
                    counts[k] = len(found)
        if not parts:
            return np.zeros(0, np.int32), counts, scores
        owner = np.concatenate([o if len(o) == len(f) else np.repeat(o, len(f)) for o, f in parts])
        ids = np.concatenate([f for _, f in parts])
        return ids[np.argsort(owner, kind="stable")], counts, scores

    def _together(self, words: list[str], size: np.ndarray):
        """The search over all words side by side, one end position after another; longest words first."""
        n, width = len(words), int(size[0])
        codes = np.zeros((width, n), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner, place = spread(np.zeros(n, np.int64), size)
        codes[place, owner] = flat
        prefix = np.zeros((width + 1, n), np.uint64)
        for k in range(width):
            prefix[k + 1] = prefix[k] * HASH + codes[k] + np.uint64(1)
        best, back, piece = np.full((width + 1, n), NONE), np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int32)
        best[0] = 0.0
        alive = np.searchsorted(-size, -np.arange(width + 1), "right")
        odd = np.zeros(n, bool)
        for end in range(1, width + 1):
            m = alive[end]
            for length in range(min(end, self.longest), 0, -1):
                start = end - length
                who, at = self.find(prefix[end, :m] - prefix[start, :m] * self.power[length], length)
                score = best[start, who] + self.hash_score[at]
                better = score > best[end, who]
                who, at = who[better], at[better]
                best[end, who], back[end, who], piece[end, who] = score[better], length, self.hash_id[at]
                if length == 1:
                    covered = np.zeros(m, bool)
                    covered[self.find(codes[end - 1, :m] + np.uint64(1), 1)[0]] = True
                    score = best[start, :m] + self.lowest
                    worse = np.flatnonzero(~covered & (score > best[end, :m]))
                    code = codes[end - 1, worse]
                    best[end, worse], back[end, worse] = score[worse], 1
                    piece[end, worse] = np.where(code < 128, self.byte_id[np.minimum(code, np.uint64(127)).astype(np.int64)], -2)
        taken = np.full((n, width), -1, np.int32)
        at, who = size.copy(), np.arange(n)
        while len(who):
            taken[who, at[who] - 1] = piece[at[who], who]
            at[who] -= back[at[who], who]
            who = who[at[who] > 0]
        odd = (taken == -2).any(1) | (not self.bytes and (taken == self.unknown).any(1))
        taken[odd] = -1
        owner, column = np.nonzero(taken >= 0)
        return owner, taken[owner, column], best[size, np.arange(n)], odd

    def normal(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.dummy_prefix and text else text

    def moves(self, text: str, at: int, stop: int):
        """(end, score) of the pieces that start at ``at``; a character that is no piece scores lowest."""
        if text[at] not in self.score:
            yield at + 1, self.lowest
        for n in self.lengths.get(text[at], ()):
            if at + n > stop:
                break
            score = self.score.get(text[at : at + n])
            if score is not None:
                yield at + n, score

    def best(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best path over a text; of equal paths, the one with the longer earlier piece."""
        stop, lengths, scores = len(text), self.lengths.get, self.score.get
        best, back = [NONE] * (stop + 1), [0] * (stop + 1)
        best[0] = 0.0
        for at in range(stop):
            here, char = best[at], text[at]
            if here == NONE:
                continue
            if scores(char) is None and here + self.lowest > best[at + 1]:
                best[at + 1], back[at + 1] = here + self.lowest, at
            for n in lengths(char, ()):
                end = at + n
                if end > stop:
                    break
                score = scores(text[at:end])
                if score is not None and here + score > best[end]:
                    best[end], back[end] = here + score, at
        path, at = [], stop
        while at:
            path.append(text[back[at] : at])
            at = back[at]
        ids = []
        for piece in reversed(path):
            i = self.id.get(piece)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids, best[stop]

    def cuts(self, text: str) -> list[int]:
        """Places that no piece spans: before a word mark after another character."""
        return [m.start() + 1 for m in re.finditer(f"[^{MARK}]{MARK}", text)] if self.words_apart else []

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, or of stretches between two states of a best path: all in a row, and where each starts.

        A word is searched once, as long as it is remembered.
        """
        if not self.words_apart:
            found = [self.best(t)[0] for t in texts]
            return np.array([i for f in found for i in f], np.int32), np.cumsum([0] + [len(f) for f in found])
        seen, per_text = [], []
        for text in texts:
            words = WORDS.findall(text)
            per_text.append(len(words))
            seen += words
        starts, counts = self.looked_up(seen)
        _, place = spread(starts, counts)
        ends = np.r_[0, np.cumsum(counts)]
        return self.store[place], ends[np.r_[0, np.cumsum(per_text)].astype(np.int64)]

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word start in ``store``, and how many they are."""
        if len(self.number) > REMEMBERED:
            self.number, self.stored = {}, 0
        number, known = self.number, len(self.number)
        seen = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
        new = list(itertools.islice(number, known, None))
        ids, counts, _ = self.many(new)
        self.store, self.store_at = roomy(self.store, self.stored + len(ids)), roomy(self.store_at, len(number))
        self.store[self.stored : self.stored + len(ids)] = ids
        self.store_at[:, known : len(number)] = self.stored + np.cumsum(counts) - counts, counts
        self.stored += len(ids)
        return self.store_at[0].take(seen), self.store_at[1].take(seen)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_all` for texts as they are; where words are single spaces apart, each different word of a batch is looked up once."""
        if not (self.words_apart and self.dummy_prefix):
            return self.encode_all([self.normal(t) for t in texts.to_pylist()])
        apart = np.asarray(pc.match_substring_regex(texts, APART), bool)
        if apart.all():
            return self.encode_all([self.normal(t) for t in texts.to_pylist()])
        lists = pc.split_pattern(texts.filter(pa.array(~apart)), " ")
        coded = lists.flatten().dictionary_encode()
        at = np.asarray(coded.indices)
        starts, counts = (x.take(at) for x in self.looked_up([MARK + w for w in coded.dictionary.to_pylist()]))
        _, place = spread(starts, counts)
        ids, ends = self.store.take(place), np.r_[0, np.cumsum(counts)].take(np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))])
        if not apart.any():
            return ids, ends
        more, more_ends = self.encode_all([self.normal(t) for t in texts.filter(pa.array(apart)).to_pylist()])
        sizes = np.zeros(len(apart), np.int64)
        sizes[apart], sizes[~apart] = np.diff(more_ends), np.diff(ends)
        out = np.empty(int(sizes.sum()), np.int32)
        from_more = np.repeat(apart, sizes)
        out[from_more], out[~from_more] = more, ids
        return out, np.r_[0, np.cumsum(sizes)]

    def forward(self, text: str, enter: np.ndarray, start: int, stop: int, beyond: int) -> np.ndarray:
        """Best scores at ``stop`` .. ``stop + longest - 1``; ``enter`` has the rows' scores at ``start`` and on.

        ``enter`` is rows by places. ``beyond`` is how far pieces may look.
        """
        rows, wide = enter.shape
        span = stop - start + self.longest
        best = np.full((span, rows), NONE)
        best[:wide] = enter.T
        for at in range(stop - start):
            here = best[at]
            if not np.isfinite(here).any():
                continue
            for end, s in self.moves(text, start + at, min(beyond, start + at + self.longest)):
                np.maximum(best[end - start], here + s, out=best[end - start])
        return best[stop - start :].T

    def transfer(self, text: str, size: int) -> np.ndarray:
        """The matrix of the chunk ``text[:size]``; what follows is what pieces may reach into."""
        n = self.longest
        enter = np.where(np.eye(n, dtype=bool), 0.0, NONE)
        cuts = [c for c in self.cuts(text) if n <= c < size]
        if not cuts:
            return self.forward(text, enter, 0, size, len(text))
        first, last = cuts[0], cuts[-1]
        head = self.forward(text, enter, 0, first, first)[:, :1]
        middle = self.many(WORDS.findall(text[first:last]))[2].sum()
        return head + middle + self.forward(text, np.zeros((1, 1)), last, size, len(text))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; an unknown piece reads as U+2047 between spaces."""
        out = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of many lists of ids, joined side by side; bytes that are no UTF-8 are replaced one text at a time."""
        pieces = pa.array(self.raw, pa.large_binary()).take(pa.array(ids))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pieces), pa.scalar(b"", pa.large_binary()))
        try:
            texts = joined.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.large_string())
        else:
            if self.dummy_prefix:
                texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        return texts.cast(pa.string())


IDS = pa.list_(pa.int32())


def as_lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())).cast(IDS)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices."""
    return np.array([(row[:, None] + b).max(0) for row in a])


def _model(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def encode(
    docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, decoded: bool = False
) -> DataFrame:
    """``docs`` as rows (id, row, ids), with ``decoded`` also the text they decode to: the best segmentation of every whole text.

    Texts of up to ``chunk`` characters are encoded where they are read. Only
    longer ones are cut, and only their chunks and matrices are shuffled. A
    null or empty text has no ids. ``row`` tells rows with equal ids apart.
    """
    path = model or default_model()
    longest = _model(path).longest
    spark = docs.sparkSession
    stages = Stages(spark)
    base = docs.select(quoted(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    base = base.withColumn("row", F.xxhash64("id", "text"))
    prefix = 1 if _model(path).dummy_prefix else 0
    kind = base.schema["id"].dataType.simpleString()
    short = base.filter(F.length("text") <= chunk)
    ddl = f"id {kind}, row bigint, ids array<int>" + (", decoded string" if decoded else "")

    def whole(batches):
        p = _model(path)
        for b in in_slices(batches):
            ids, ends = p.encode_texts(b["text"])
            more = {"decoded": p.decode_all(ids, ends)} if decoded else {}
            yield pa.RecordBatch.from_pydict({"id": b["id"], "row": b["row"], "ids": as_lists(ids, ends), **more})

    plain = short.select("id", "row", "text").mapInArrow(whole, ddl)
    # a chunk carries the characters that its last piece may reach into
    long = stages(base.filter(F.length("text") > chunk).groupBy("id", "row", "text").agg(F.count(F.lit(1)).alias("copies")))

    def chunks(batches):
        for b in in_slices(batches, 1):
            row, text = b["row"][0].as_py(), b["text"][0].as_py()
            for k, at in enumerate(range(0, len(text), chunk)):
                yield pa.RecordBatch.from_pydict({
                    "row": [row], "part": pa.array([k], pa.int32()), "text": [text[at : at + chunk + longest]],
                    "size": pa.array([min(chunk, len(text) - at)], pa.int32())})

    parts = long.select("row", "text").mapInArrow(chunks, "row bigint, part int, text string, size int")
    parts = stages(parts.repartition(partitions(spark, 1, 1), "row", "part"))

    def text_at(p: Pieces, part: int, text: str) -> tuple[str, int]:
        """The normalised stretch and what the word mark before the text adds to the first chunk."""
        return (p.normal(text), prefix) if part == 0 else (text.replace(" ", MARK), 0)

    def matrices(batches):
        p = _model(path)
        for b in in_slices(batches, 32):
            made = []
            for part, size, text in zip(b["part"].to_pylist(), b["size"].to_pylist(), b["text"].to_pylist()):
                text, more = text_at(p, part, text)
                made.append(p.transfer(text, size + more).astype("<f8").tobytes())
            yield pa.RecordBatch.from_pydict({"row": b["row"], "part": b["part"], "m": made}, schema=pa.schema(
                [("row", pa.int64()), ("part", pa.int32()), ("m", pa.binary())]))

    table_of = "row bigint, part int, m binary"
    made = stages(parts.mapInArrow(matrices, table_of))
    n = longest

    def read(m: bytes) -> np.ndarray:
        return np.frombuffer(m, "<f8").reshape(n, n)

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("part"), None
        for m in rows["m"]:
            out = read(m) if out is None else combine(out, read(m))
        return pd.DataFrame({"row": [rows["row"].iloc[0]], "block": [rows["part"].iloc[0] // BLOCK], "m": [out.tobytes()]})

    blocks = made.withColumn("block", F.expr(f"part div {BLOCK}").cast("int"))
    summed = blocks.groupBy("row", "block").applyInPandas(product, "row bigint, block int, m binary")

    def states(rows: pd.DataFrame, place: str, enter: int, leave: int | None) -> tuple[list[int], list[int]]:
        """States before and after each matrix on the best path from ``enter`` to ``leave``."""
        ms = [read(m) for m in rows.sort_values(place)["m"]]
        ahead = [np.where(np.arange(n) == enter, 0.0, NONE)]
        for m in ms:
            ahead.append((ahead[-1][:, None] + m).max(0))
        at, out = (0 if leave is None else leave), []
        for m, v in zip(reversed(ms), reversed(ahead[:-1])):
            before = int(np.argmax(v + m[:, at]))
            out.append((before, at))
            at = before
        return [x[0] for x in reversed(out)], [x[1] for x in reversed(out)]

    def between(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        a, b = states(rows, "block", 0, None)
        return pd.DataFrame({"row": rows["row"], "block": rows["block"], "enter": a, "leave": b})

    tops = stages(summed.groupBy("row").applyInPandas(between, "row bigint, block int, enter int, leave int"))

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        a, b = states(rows, "part", int(rows["enter"].iloc[0]), int(rows["leave"].iloc[0]))
        return pd.DataFrame({"row": rows["row"], "part": rows["part"], "enter": a, "leave": b})

    cuts = stages(blocks.join(tops, ["row", "block"]).groupBy("row", "block").applyInPandas(inside, "row bigint, part int, enter int, leave int"))

    def trace(batches):
        p = _model(path)
        for b in in_slices(batches, 32):
            stretches = []
            for part, size, text, enter, leave in zip(*(b[c].to_pylist() for c in ("part", "size", "text", "enter", "leave"))):
                text, more = text_at(p, part, text)
                stretches.append(text[enter : size + more + leave])
            yield pa.RecordBatch.from_arrays([b["row"], b["part"], as_lists(*p.encode_all(stretches))], schema=pa.schema(
                [("row", pa.int64()), ("part", pa.int32()), ("ids", IDS)]))

    traced = parts.join(cuts, ["row", "part"]).mapInArrow(trace, "row bigint, part int, ids array<int>")
    whole_ids = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p")).select(
        "row", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    joined = long.select("id", "row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("c")).join(whole_ids, "row")
    joined = joined.select("id", "row", "ids")
    return plain.unionByName(decode(joined, path) if decoded else joined)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` (id, row, ids) with the text that the ids stand for; no ids are an empty text."""
    path = model or default_model()
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        p = _model(path)
        for b in in_slices(batches):
            ids, ends = np.asarray(b["ids"].flatten()), np.r_[0, np.cumsum(np.asarray(pc.fill_null(b["ids"].value_lengths(), 0)))]
            yield pa.RecordBatch.from_pydict({"id": b["id"], "row": b["row"], "ids": b["ids"], "decoded": p.decode_all(ids, ends)})

    return encoded.select("id", "row", "ids").mapInArrow(run, f"id {kind}, row bigint, ids array<int>, decoded string")


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, n_pieces, ids, decoded) of every text; short texts are encoded and decoded in one pass.

    Ids of any type are carried as they are. A null or empty text has no pieces
    and decodes to an empty text; repeated rows stay. Of equally good paths the
    one with the longer earlier piece is taken within a chunk; a text of over
    ``chunk`` characters may be cut otherwise there than in one go, at the same
    score. An empty table gives an empty result.
    """
    out = encode(docs, id_col=id_col, text_col=text_col, decoded=True, **options)
    return out.select(F.col("id").alias(id_col), F.size("ids").alias("n_pieces"), "ids", "decoded")
