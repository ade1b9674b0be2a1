"""Best-fit packing of tokenised documents into sequences of bounded length.

A fixed number of bins is open at a time. A bitset has one bit for each amount
of free space that some open bin has, so the tightest bin that still takes a
piece is one shift and one lowest set bit away, whatever the number of bins.
Where none takes it and all bins are in use, the fullest closes first.

Each task packs its own share of the pieces and never looks ahead. It is fed
longest pieces first, since the short ones then fill what the long ones leave.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import held, quoted, text_of

CAPACITY = 2048
OPEN_BINS = 4096
END = 0
# Pieces packed together by one task, and about how many bytes a full piece comes from.
SHARE = 16_384
PIECE_BYTES = 8192
# Longer texts are encoded in parts, cut where the tokenizer cuts in any case.
PART_CHARS = 1 << 20
CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
BATCH_TEXTS, BATCH_BYTES = 256, 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class OpenBins:
    """Bounded-space best-fit: at most ``limit`` open bins of one ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.free = 0  # bit f is set while a bin with f free places is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.in_use = 0

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.in_use -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece of 1 to ``capacity`` tokens, and its place there."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.in_use == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, space = self.opened, self.capacity
            self.opened += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.in_use += 1
        return number, self.capacity - space


def parts_of(text: str, chars: int = PART_CHARS) -> list[str]:
    """A text in parts of about ``chars``, cut before a space between two letters, where a word of the tokenizer starts."""
    parts, at = [], 0
    while len(text) - at > chars:
        cut = CUT.search(text, at + chars)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level BPE file whose ids are its merge ranks; None for any other file."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or whole.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    ids = model["vocab"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if len(ids) != 256 + len(merges) or any(ids.get(m) != 256 + k for k, m in enumerate(merges)):
        return None
    # the file writes bytes that do not print as characters from 256 on
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}
    return {bytes(char[c] for c in token): i for token, i in ids.items()}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    Where the file allows it, the merges are done by tiktoken on the same
    vocabulary, which gives equal ids in a quarter of the time. Texts with an
    added token or a very long run of white space go through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.apart = "|".join([*added, r"[\s\x0b\x{85}\p{Z}]{256}"])
        ranks, self.fast = ranks_of(path), None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str], end: int = END) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        parts = [parts_of(t) for t in texts]
        flat = [p for some in parts for p in some]
        slow = range(len(flat))
        found: list = [None] * len(flat)
        if self.fast:
            apart = pc.match_substring_regex(pa.array(flat, pa.large_string()), self.apart).to_pylist()
            found = [None if a else self.fast.encode_to_numpy(p, disallowed_special=()) for p, a in zip(flat, apart)]
            slow = [k for k, a in enumerate(apart) if a]
        for k, e in zip(slow, self.library.encode_batch_fast([flat[k] for k in slow], add_special_tokens=False)):
            found[k] = np.array(e.ids, "<u4")
        left = iter(found)
        return [np.concatenate([*(next(left) for _ in some), np.array([end])]).astype("<u4") for some in parts]


def cuts(size: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document; all but the first are full."""
    first = (size - 1) % capacity + 1
    edges = [0, *range(first, size + 1, capacity)]
    return list(zip(edges, edges[1:]))


def pieces_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, salt), with ``with_ids`` also the ids themselves.

    A null or empty text is the end id alone. Only documents of more than
    ``capacity`` ids are cut. Repeated rows and null ids stay as they are;
    ``salt`` counts the pieces of a task and tells repeated rows apart.
    """
    model = tokenizer or default_tokenizer()
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())]
    ddl = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        ddl += ", ids array<bigint>"
    schema = pa.schema(fields)

    def rows_of(doc_ids, texts, salt):
        rows = []
        for doc, ids in zip(doc_ids, held(("packing", model), lambda: Encoder(model)).encode(texts, end)):
            for k, (a, b) in enumerate(cuts(len(ids), capacity)):
                part = ids[a:b]
                rows.append((doc, k, a, b - a, zlib.crc32(part.tobytes()), salt + len(rows), *([part.astype(np.int64)] if with_ids else [])))
        return rows

    def run(batches):
        salt = 0
        for batch in batches:
            doc_ids, texts, size = [], [], 0
            last = batch.num_rows - 1
            for k in range(batch.num_rows):
                doc_ids.append(batch["id"][k].as_py())
                texts.append(batch["text"][k].as_py())
                size += len(texts[-1])
                if len(texts) < BATCH_TEXTS and size < BATCH_BYTES and k < last:
                    continue
                rows = rows_of(doc_ids, texts, salt)
                salt += len(rows)
                doc_ids, texts, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(quoted(id_col).cast("bigint").alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(run, ddl)


def pack(pieces: DataFrame, shares: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows (id, piece, length, ids_crc32, salt, ...); a group of pieces is packed per share.

    Pieces are dealt to shares by a hash, so copies and long documents spread
    evenly. Ties in length go by id, piece and checksum.
    """
    kept = [f for f in pieces.schema if f.name != "salt"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    share = F.pmod(F.xxhash64("id", "piece", "ids_crc32", "salt"), F.lit(shares)).alias("share")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins = OpenBins(capacity, open_bins)
        places = np.array([bins.place(n) for n in table["length"].to_pylist()], np.int64).reshape(-1, 2)
        first = table["share"][0].as_py() << 32
        out = table.select([f.name for f in kept])
        return out.append_column("sequence_id", pa.array(places[:, 0] + first)).append_column("offset", pa.array(places[:, 1]))

    return pieces.select("*", share).groupBy("share").applyInArrow(fill, ddl)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and their places.

    The text is read once more for its size, which sets the number of shares
    and nothing else. An empty table gives an empty result.
    """
    n, size = docs.select(F.count(F.lit(1)), F.sum(F.octet_length(text_of(docs, text_col)))).first()
    shares = max(1, -(-(n + (size or 0) // PIECE_BYTES) // SHARE))
    return pack(pieces_of(docs, id_col, text_col, tokenizer, capacity, with_ids=with_ids), shares, capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, doc_ids): the token ids of each sequence, from pieces packed ``with_ids``."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids", "id")))
    return packed.groupBy("sequence_id").agg(placed.alias("__p")).select(
        "sequence_id", F.flatten(F.col("__p.ids")).alias("ids"), F.col("__p.id").alias("doc_ids"))
