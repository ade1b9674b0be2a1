"""Keep or exclude rows by a list of keys.

Exact and case-insensitive matching are semi and anti joins on the key.
Substring matching never pairs every row with every key: see :func:`_contains`.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowrinse.functions.text import blank, col, strip
from rowrinse.session import stage

# A list this short is cheaper as a literal set in the filter than as a join.
LITERAL_KEYS = 200
# Up to here each key is one native substring test in generated code.
LITERAL_PATTERNS = 16
# Bytes of the stretches that texts and keys are compared by first; up to 8, so that a stretch is a number.
GRAMS = (1, 2, 3, 5, 8)
# Which grams keys have, as so many bits whatever the number of keys; places of a text that are looked at together.
FILTER_BITS = 22
PLACES = 1 << 20

_KEY = "__key"


def clean_keys(keys: Sequence[str] | DataFrame) -> list[str] | DataFrame:
    """Keys trimmed, blanks and repeats dropped; a DataFrame stays distributed."""
    if isinstance(keys, DataFrame):
        c = col(keys.columns[0]).cast("string")
        return keys.filter(~blank(c, T.StringType())).select(strip(c).alias(_KEY)).distinct()
    return list(dict.fromkeys(k.strip() for k in keys if k and k.strip()))


def match_keys(
    df: DataFrame,
    column: str,
    keys: Sequence[str] | DataFrame | None,
    mode: str = "keep",
    how: str = "exact",
) -> DataFrame:
    """Rows whose ``column`` is (``keep``) or is not (``exclude``) matched by the keys.

    ``how`` is ``exact``, ``case_insensitive`` or ``contains``. A null cell
    never passes, in either mode. An unknown column or empty list is a no-op.
    """
    if column not in df.columns or keys is None:
        return df
    keys = clean_keys(keys)
    keep = mode.lower() == "keep"
    text = col(column).cast("string")
    if how.lower() == "contains" and isinstance(keys, DataFrame):
        return contains_by_grams(df, text, keys, keep)  # looks at the keys itself
    if keys.isEmpty() if isinstance(keys, DataFrame) else not keys:
        return df
    if how.lower() == "contains":
        return _contains(df, text, keys, keep)
    if how.lower() == "case_insensitive":
        text = F.lower(text)
        keys = keys.select(F.lower(_KEY).alias(_KEY)).distinct() if isinstance(keys, DataFrame) else list({k.lower(): 0 for k in keys})
    if not isinstance(keys, DataFrame) and len(keys) <= LITERAL_KEYS:
        found = text.isin(*keys)
        return df.filter(found if keep else ~found)
    return _by_join(df, text, _as_table(df, keys), keep)


def _as_table(df: DataFrame, keys: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(keys, DataFrame):
        return keys
    # an Arrow table becomes a local relation, so the planner knows its size
    return df.sparkSession.createDataFrame(pa.table({_KEY: pa.array(keys, pa.string())}))


def _by_join(df: DataFrame, text: Column, keys: DataFrame, keep: bool) -> DataFrame:
    """Semi or anti join; the planner broadcasts the keys only where their size allows."""
    if keep:
        return df.join(keys, text == F.col(_KEY), "left_semi")
    return df.filter(text.isNotNull()).join(keys, text == F.col(_KEY), "left_anti")


def _contains(df: DataFrame, text: Column, keys: Sequence[str], keep: bool) -> DataFrame:
    """Substring match: a native test for each key of a short list, joins on grams for any other."""
    if len(keys) <= LITERAL_PATTERNS:
        found = functools.reduce(operator.or_, [text.contains(k) for k in keys])
        return df.filter(found if keep else ~found)
    return contains_by_grams(df, text, _as_table(df, keys), keep)


def _cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts one after another, 8 zeros behind them, and where each text ends."""
    cells = texts.cast(pa.large_binary())
    ends = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    data = cells.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return np.r_[bytes_, np.zeros(8, np.uint8)], ends[1:] - ends[0]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def _grams(data: np.ndarray, ends: np.ndarray, width: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, gram) of the stretches of ``width`` bytes, those outside the filter left out; a gram once per text and block of places."""
    total = len(data) - 8
    for at in range(0, total, PLACES):
        grams = np.ndarray(min(PLACES, total - at), "<u8", data, at, (1,)) & np.uint64((1 << 8 * width) - 1)
        places = np.arange(len(grams)) if wanted is None else np.flatnonzero(wanted.take(_bucket(grams).view(np.int64)))
        texts = np.searchsorted(ends, places + at, "right")
        inside = places + at + width <= ends[texts]
        texts, grams = texts[inside], grams[places[inside]]
        order = np.lexsort((grams, texts))
        texts, grams = texts[order], grams[order]
        first = np.r_[True, (texts[1:] != texts[:-1]) | (grams[1:] != grams[:-1])][: len(texts)]
        yield texts[first], grams[first]


def _width_of(length: Column, widths: Sequence[int]) -> Column:
    """The widest gram that fits a key of this length."""
    return functools.reduce(lambda out, w: F.when(length >= w, w).otherwise(out), sorted(widths), F.lit(None).cast("int"))


def key_grams(keys: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Rows (__key, __gram, __bucket): the grams of each key, of the widest width that fits it, and their bits in the filter."""
    schema = pa.schema([(_KEY, pa.string()), ("__gram", pa.int64()), ("__bucket", pa.int64())])

    def cut(batches):
        for batch in batches:
            sizes = np.array([len(k.encode()) for k in batch[0].to_pylist()], np.int64)
            fits = np.searchsorted(widths, sizes, "right") - 1
            for k, width in enumerate(widths):
                some = batch[0].filter(pa.array(fits == k))
                for texts, grams in _grams(*_cells(some), width):
                    yield pa.RecordBatch.from_arrays(
                        [some.take(pa.array(texts)), pa.array(grams.view(np.int64)), pa.array(_bucket(grams).view(np.int64))], schema=schema)

    return keys.mapInArrow(cut, f"{_KEY} string, __gram bigint, __bucket bigint")


def filter_of(keyed: DataFrame) -> np.ndarray:
    """For each bucket whether a gram of a key is in it; 2^FILTER_BITS of them, 64 to a row."""
    words = keyed.groupBy(F.expr("__bucket div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(__bucket % 64 as int)))").alias("bits"))
    found = words.toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def held_grams(texts: DataFrame, wanted: np.ndarray, widths: Sequence[int]) -> DataFrame:
    """Rows (__id, __gram): the grams of texts (__id, __text) that pass the filter of the keys' grams."""
    schema = pa.schema([("__id", pa.int64()), ("__gram", pa.int64())])

    def find(batches):
        bits = np.unpackbits(wanted.astype("<i8").view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            data, ends = _cells(batch["__text"])
            for width in widths:
                for rows, grams in _grams(data, ends, width, bits):
                    yield pa.RecordBatch.from_arrays([batch["__id"].take(pa.array(rows)), pa.array(grams.view(np.int64))], schema=schema)

    return texts.select("__id", "__text").mapInArrow(find, "__id bigint, __gram bigint")


def contains_by_grams(df: DataFrame, text: Column, keys: DataFrame, keep: bool, widths: Sequence[int] = GRAMS) -> DataFrame:
    """Substring match for a key list of any length, by the rarest gram of each key.

    A text can hold a key only if it holds all grams of the key. Of these the
    one that fewest texts hold is looked up, and only texts that hold it are
    searched for the key itself. A filter of fixed size, in which each gram of
    a key has a bit, drops nearly all grams that no key has where a text is
    read, so what is written grows with the grams that keys and texts share.
    A text is shuffled once at most, to meet its keys. An empty list is a no-op.
    """
    widest = _width_of(F.octet_length(_KEY), widths)
    used = sorted(keys.agg(F.collect_set(widest)).first()[0])  # at most one number per width
    if not used:
        return df
    keyed = stage(key_grams(keys.select(_KEY), used))
    present = df.filter(text.isNotNull())
    texts = present.select(text.alias("__text")).select("__text", F.xxhash64("__text").alias("__id"))
    held = stage(held_grams(texts, filter_of(keyed), used))
    often = held.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    # a key with a gram that no text holds is in none
    counted = keyed.join(often, "__gram", "left")
    rarest = counted.groupBy(_KEY).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("least"))
    rarest = rarest.filter(F.col("least.n") > 0).select(_KEY, "least.__gram")
    # written, so that adaptive execution can split the copies of a text in the join below
    asked = stage(held.join(rarest, "__gram").groupBy("__id").agg(F.collect_set(_KEY).alias("__keys")))
    # one row per hash, so the join adds no rows; texts that share one are searched for each other's keys too, which changes nothing
    columns = [col(c) for c in df.columns]
    # a left join for either mode: as a condition of an inner one the search is also pushed to the side that has no text
    searched = present.join(asked, F.xxhash64(text) == F.col("__id"), "left")
    holds = F.coalesce(F.exists("__keys", lambda k: text.contains(k)), F.lit(False))
    return searched.filter(holds if keep else ~holds).select(*columns)
