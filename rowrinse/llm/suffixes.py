"""Removal of repeated passages by hash ranks of anchored ranges of positions.

This is not prefix doubling, which ranks every position by its first h bytes, then by pairs of
ranks h apart, and drops positions as soon as their rank is unique. Ranking
each byte moves many times the input, whose cost the README gives.
Two things differ, neither of which changes the result:

* Positions are filed by an anchor: in each stretch of the threshold's length,
  the 16 bytes with the least hash, a place that equal stretches agree on.
  Stretches with one anchor are consecutive starts, and one row stands for all.
* A rank is a hash of the bytes it ranks, so a round is a count by rank. First
  the half of the threshold at one side of the anchor is ranked. Unique ones
  are dropped; of what is left, the pair of a rank and the rest, the whole
  range of the row, is ranked. A range that is unique although its half is not
  lies at the edge of a repeat. Such ranges are cut into short ones, which are
  ranked in the same two ways, and only the starts of those that are left then
  are ranked one by one.

Ranks that decide have 128 bits. Joins on a rank that many rows share deal
those rows by a salt as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import Stages, in_slices, quoted, text_of

LENGTH = 400
GRAM = 16
PIECE = 1 << 20
PLACE = np.uint64((1 << 31) - 1)

SHORT = 24
SALTS = 256
HOT = 1024

RANGES = "th_hi bigint, th_lo bigint, pick int, s1 int, s2 int, anchor int, half bigint, all_hi bigint, all_lo bigint"
CHUNKS = "th_hi bigint, th_lo bigint, r1 int, s1 int, s2 int, known boolean, half bigint, all_hi bigint, all_lo bigint"
STARTS = "th_hi bigint, th_lo bigint, s int, known boolean, all_hi bigint, all_lo bigint"
TEXT, RANK = ["th_hi", "th_lo"], ["all_hi", "all_lo"]


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def halves_of(digests: list[int]) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << 64) - 1
    return signed([d >> 64 for d in digests]), signed([d & low for d in digests])


def anchors(data: bytes, length: int = LENGTH, start: int = 0, stop: int | None = None):
    """Runs of starts that share an anchor: arrays (first start, last start, anchor) for starts in start .. stop."""
    stop = len(data) - length + 1 if stop is None else stop
    part = data[start : stop + length - 1]
    n = len(part) - GRAM + 1
    words = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8 : 8 + n]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    key = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
    # least key of each stretch: suffix minima of one block, prefix minima of the next
    wide = length - GRAM + 1
    padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - wide + 1], ahead[wide - 1 : n])
    at = (least & PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    return first + start, last + start, at[first] + start


def ranges_of(data: bytes, length: int = LENGTH):
    """(first start, last start, anchor, rank of the half, rank of the whole range) of every run, cut at the half."""
    half = length // 2
    digest, wide = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
    view = memoryview(data)
    out = []
    for begin in range(0, len(data) - length + 1, PIECE):
        runs = anchors(data, length, begin, min(begin + PIECE, len(data) - length + 1))
        for first, last, at in zip(*(r.tolist() for r in runs)):
            turn = at - half
            if last >= turn:
                low = max(first, turn)
                out.append((low, last, at, digest(view[at : at + half], 1), wide(view[low : last + length], 2 * (at - low))))
            if first < turn:
                high = min(last, turn - 1)
                out.append((first, high, at, digest(view[turn : at + GRAM], 2), wide(view[first : high + length], 2 * (at - first) + 1)))
    return out


def chunks_of(context: bytes, s1: int, s2: int, anchor: int, length: int = LENGTH):
    """(first start, last start, rank of what their stretches share, rank of the range) of the short ranges of a range.

    They are cut at whole numbers of short ranges before the anchor, so equal stretches fall alike.
    """
    digest, wide = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
    short = min(SHORT, length // 2)
    view, out, first = memoryview(context), [], s1
    while first <= s2:
        edge = anchor - (anchor - first) // short * short
        last = min(s2, edge)
        core = digest(view[edge - s1 : edge - short + 1 + length - s1], 3)
        out.append((first, last, core, wide(view[first - s1 : last + length - s1], anchor - first)))
        first = last + 1
    return out


def keyed(docs: DataFrame, text_col: str, *more) -> DataFrame:
    """``docs`` with the 128-bit digest of each text as two numbers."""
    base = docs.select(*more, text_of(docs, text_col).alias("text"))
    digest = F.md5("text")
    part = lambda at: F.expr(f"cast(conv(substring(__md5, {at}, 15), 16, 10) as bigint)")
    return base.withColumn("__md5", digest).select(
        *base.columns, part(1).alias("th_hi"), part(16).alias("th_lo"))


def other_columns(docs: DataFrame, text_col: str) -> Column:
    """A hash that tells rows with one text apart."""
    return F.xxhash64(*[quoted(c) for c in docs.columns if c != text_col]).alias("row")


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """A batch from tuples; unsigned 64-bit ranks become signed, and a 128-bit rank two numbers."""
    columns = list(zip(*rows)) if rows else [()] * (len(schema) - 1)
    *plain, whole = columns
    arrays = []
    for field, values in zip(schema, plain):
        if field.type == pa.int64():
            values = np.array([v & 0xFFFFFFFFFFFFFFFF for v in values], np.uint64).view(np.int64)
        arrays.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays([*arrays, *map(pa.array, halves_of(list(whole)))], schema=schema)


def frequent(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold over a share of 1 / ``HOT`` of all that ``counts`` counts: fewer than ``HOT``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > max(total / HOT, SALTS)).select(*keys)


def salted(rows: DataFrame, others: DataFrame, keys: list[str], hot: DataFrame, how: str, by: list[str]) -> DataFrame:
    """``rows`` joined with ``others``, which has a row a key; rows of the ``hot`` keys are dealt by ``by`` too.

    ``others`` grows with the texts and is exploded here, so it is not broadcast by the size of its files.
    """
    flag = F.broadcast(hot.withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(flag, keys, "left").withColumn("salt", salt).drop("hot")
    right = others.join(flag, keys, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return left.join(right.hint("merge"), [*keys, "salt"], how).drop("salt")


def sift(ranges: DataFrame, stages: Stages, key: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of ranges with ranks (half, all_hi, all_lo) those that may repeat, and their classes.

    The rows whose half is unique go. A class is the rows of one whole rank,
    with one of them, its number of rows ``n``, and whether its half is in
    other classes too (``mixed``). ``known`` marks ranges that are known to
    repeat. ``by`` are the columns that tell the rows of a half apart.
    """
    shared = stages(ranges.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = frequent(shared, ["half"])
    left = stages(salted(ranges, shared.select("half"), ["half"], hot, "left_semi", by))
    # written before the join, so that the grouping is dealt by all its keys and not by a half that many rows share
    classes = stages(left.groupBy("half", *RANK).agg(
        F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) > 1) | F.max("known")).alias("known"),
        *[F.first(c).alias(c) for c in key]))
    mixed = classes.groupBy("half").agg((F.count(F.lit(1)) > 1).alias("mixed")).filter("mixed")
    flagged = salted(classes, mixed, ["half"], hot, "left", RANK)
    return left, stages(flagged.withColumn("mixed", F.col("mixed").isNotNull()).drop("half"))


def repeated_starts(docs: DataFrame, stages: Stages, text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """For the texts in which a stretch starts that starts elsewhere too: (marked texts, digests that very many rows share).

    A marked text is a row (th_hi, th_lo, text, marks), one per text digest. A
    mark is a range of starts, s1 .. s2, or, with ``mask``, single starts from
    s1 on by bits. Nothing is left of a text of the second table, as it repeats.
    """
    long = keyed(docs, text_col, other_columns(docs, text_col))
    long = long.filter(F.octet_length("text") >= length)
    schemas = {ddl: arrow_schema(ddl) for ddl in (RANGES, CHUNKS, STARTS)}

    def file(batches):
        for b in in_slices(batches):
            rows = []
            for hi, lo, text in zip(b["th_hi"].to_pylist(), b["th_lo"].to_pylist(), b["text"].to_pylist()):
                rows += [(hi, lo, i % SALTS, *r) for i, r in enumerate(ranges_of(text.encode(), length), len(rows))]
            yield arrow_rows(schemas[RANGES], rows)

    filed = stages(long.select("th_hi", "th_lo", "text").mapInArrow(file, RANGES))
    left, classes = sift(filed.withColumn("known", F.lit(False)), stages, [*TEXT, "s1", "s2", "anchor"], ["pick"])
    stages.drop(filed)

    def marked(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
        found = found.filter("known").select(*RANK, "n")
        hits = salted(rows.filter("not known"), found.drop("n"), RANK, frequent(found, RANK), "left_semi", by)
        return hits.select(*TEXT, "s1", "s2")

    whole = marked(left, classes, ["pick"]).distinct()

    # one text for each digest that still matters, with the ranges to be cut
    cut = classes.filter("mixed").groupBy(*TEXT).agg(F.collect_list(F.struct("s1", "s2", "anchor", "known")).alias("ranges"))
    one = stages(long.groupBy(*TEXT).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")))
    hot = frequent(one, TEXT)
    wanted = left.select(*TEXT).distinct().join(one.drop("n"), TEXT).join(cut, TEXT, "left")
    texts = stages(long.join(wanted, [*TEXT, "row"]).dropDuplicates([*TEXT, "row"]).drop("row"))
    ranges = texts.select(*TEXT, "text", F.explode("ranges").alias("r")).select(*TEXT, "text", "r.*")
    context = F.substring(F.encode("text", "UTF-8"), F.col("s1") + 1, F.col("s2") - F.col("s1") + length)
    contexts = stages(ranges.select(*TEXT, F.col("s1").alias("r1"), "s2", "anchor", "known", context.alias("context")))

    def chunk(batches):
        for b in in_slices(batches):
            rows = []
            for hi, lo, r1, s2, anchor, known, data in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(hi, lo, r1, f, t, known, core, all_) for f, t, core, all_ in chunks_of(data, r1, s2, anchor, length)]
            yield arrow_rows(schemas[CHUNKS], rows)

    chunks = contexts.mapInArrow(chunk, CHUNKS)
    short_left, short_classes = sift(stages(chunks), stages, [*TEXT, "r1", "s1", "s2"], [*TEXT, "s1"])
    short = marked(short_left, short_classes, [*TEXT, "s1"])

    def start(batches):
        wide = xxhash.xxh3_128_intdigest
        for b in in_slices(batches):
            rows = []
            for hi, lo, r1, s1, s2, known, data in zip(*(c.to_pylist() for c in b.columns)):
                view = memoryview(data)
                rows += [(hi, lo, s, known, wide(view[s - r1 : s - r1 + length])) for s in range(s1, s2 + 1)]
            yield arrow_rows(schemas[STARTS], rows)

    edges = short_classes.filter("mixed").select(*TEXT, "r1", "s1", "s2", "known").join(
        contexts.select(*TEXT, "r1", "context"), [*TEXT, "r1"])
    starts = stages(edges.select(*TEXT, "r1", "s1", "s2", "known", "context").mapInArrow(start, STARTS))
    twice = stages(starts.groupBy(*RANK).agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known")).filter("n > 1 or known"))
    single = salted(starts.filter("not known"), twice.select(*RANK), RANK, frequent(twice, RANK), "left_semi", [*TEXT, "s"])
    bits = single.groupBy(*TEXT, F.expr("s div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, s % 32))").alias("mask"))
    marks = whole.unionByName(short).withColumn("mask", F.lit(0).cast("bigint")).unionByName(
        bits.select(*TEXT, (F.col("word") * 32).cast("int").alias("s1"), F.lit(-1).alias("s2"), "mask"))
    out = marks.groupBy(*TEXT).agg(F.collect_list(F.struct("s1", "s2", "mask")).alias("marks"))
    return texts.select(*TEXT, "text").join(out, TEXT), hot


def covered(size: int, marks: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """Which bytes the marked stretches cover."""
    step = np.zeros(size + 1, np.int32)
    if marks:
        s1, s2, mask = (np.array([m[k] for m in marks], np.int64) for k in ("s1", "s2", "mask"))
        full = mask == 0
        np.add.at(step, s1[full], 1)
        np.add.at(step, s2[full] + length, -1)
        which, bit = np.nonzero((mask[~full][:, None] >> np.arange(32)) & 1)
        at = s1[~full][which] + bit
        np.add.at(step, at, 1)
        np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def cut_texts(marked: DataFrame, stages: Stages, length: int, keep: tuple[DataFrame, ...]) -> DataFrame:
    """Rows (th_hi, th_lo, n_removed, n_spans, cut_sha256, kept) of the marked texts, written once."""
    ddl = "th_hi bigint, th_lo bigint, n_removed bigint, n_spans bigint, cut_sha256 string, kept string"
    schema = arrow_schema(ddl)

    def cut(batches):
        for b in in_slices(batches):
            rows = []
            for hi, lo, text, found in zip(*(b[c].to_pylist() for c in (*TEXT, "text", "marks"))):
                data = text.encode()
                gone = covered(len(data), found, length)
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((hi, lo, len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)], schema=schema)

    out = stages(marked.select(*TEXT, "text", "marks").mapInArrow(cut, ddl))
    stages.close(keep=(out, *keep))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every text as UTF-8 bytes.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else too, in another document or in the same, judged on the input. Null
    and shorter texts stay as they are, a null one as an empty text; repeated
    rows are copies of each other; an empty table gives no rows. The digest is
    that of the remaining bytes; in ``kept_text`` a character that loses a
    byte goes whole.
    """
    stages = Stages(docs.sparkSession)
    marked, hot = repeated_starts(docs, stages, text_col, length)
    hot = stages(hot)
    cut = cut_texts(marked, stages, length, keep=(hot,))
    rows = keyed(docs, text_col, quoted(id_col).cast("bigint").alias("id"), other_columns(docs, text_col)).select(
        "id", "row", *TEXT, "text", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    return salted(rows, cut, TEXT, hot, "left", ["row"]).select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"), F.coalesce("kept", "text").alias("kept_text"))


def drop_repeats(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes gone from its texts; a character that loses a byte goes whole.

    All rows stay, repeated ones too; null, empty and shorter texts do not
    change. ``chars_col``, where there is one, follows the text.
    """
    stages = Stages(docs.sparkSession)
    marked, hot = repeated_starts(docs, stages, text_col, length)
    hot = stages(hot)
    changed = cut_texts(marked, stages, length, keep=(hot,)).select(*TEXT, "kept")
    names = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    rows = keyed(docs, text_col, *[quoted(c).alias(inner[c]) for c in names], other_columns(docs, text_col)).drop("text")
    rows = salted(rows, changed, TEXT, hot, "left", ["row"])
    out = []
    for c in names:
        new = F.col("kept") if c == text_col else F.length("kept").cast(docs.schema[c].dataType) if c == chars_col else None
        old = F.col(inner[c])
        out.append((old if new is None else F.when(F.col("kept").isNull(), old).otherwise(new)).alias(c))
    return rows.select(*out)
