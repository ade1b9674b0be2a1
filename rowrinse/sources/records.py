"""Records that span lines, found in byte ranges side by side.

Whether a line stands inside a quoted field, or how deep in brackets a piece
of JSON is, depends on all text before it. A task that reads a byte range of a
file therefore works out where the range leads to from each state it may begin
in. These transfers combine in the order of the ranges, so each range's true
first state follows, and the ranges are cut into records independently. Only
the pieces of records that cross ranges, at most two of a range, are joined.

Text is read with a separator at which no record can break midway: the line
break for delimited files, the closing brace for JSON, whose arrays may have
no line breaks at all.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowrinse.session import stage

PIECES = "file string, start bigint, seq bigint, head boolean, open boolean, text string"
_SCHEMA = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("head", pa.bool_()), ("open", pa.bool_()), ("text", pa.string())])
_ROWS = 4096


class QuotedLines:
    """Lines of a delimited file. State 1 is inside a quoted field; there is no depth.

    A quote opens a field only at its start; elsewhere in an unquoted field it
    is a character. Two quotes in a quoted field are one. What follows a
    closing quote up to the separator belongs to the field.
    """

    break_at, joint = "\n", "\n"

    def __init__(self, sep: str = ","):
        self.sep = sep

    def after(self, inside: int, line: str) -> tuple[int, int]:
        """The state behind a line, and by how much it is deeper."""
        if '"' not in line:
            return inside, 0
        sep, width, at = self.sep, len(self.sep), 0
        while True:
            found = line.find('"', at)
            if found < 0:
                return inside, 0
            at = found + 1
            if inside:
                if line.startswith('"', at):
                    at += 1
                else:
                    inside = 0
            elif found == 0 or line[found - width : found] == sep:
                inside = 1

    def cut(self, state: int, depth: int, lines: Iterator[str]) -> Iterator[tuple[bool, bool, str]]:
        """Pieces (head, open, text) of a range: ``head`` goes on from an earlier range, ``open`` in a later one."""
        head, kept = bool(state), []
        for line in lines:
            state, _ = self.after(state, line)
            if state:
                kept.append(line)
            elif kept or head:
                yield head, False, "\n".join([*kept, line])
                head, kept = False, []
            else:
                yield False, False, line
        if kept or (head and state):
            yield head, True, "\n".join(kept)


class JsonArray:
    """Text of a JSON array of records up to each closing brace. State 1 is inside a string."""

    break_at, joint = "}", ""
    _escape = re.compile(r"\\.", re.DOTALL)
    _between = re.compile(r"[\s\[\],]*")

    def after(self, inside: int, text: str) -> tuple[int, int]:
        parts = (self._escape.sub("", text) if "\\" in text else text).split('"')
        plain = "".join(parts[inside::2])
        inside ^= (len(parts) - 1) & 1
        deeper = plain.count("{") + plain.count("[") - plain.count("]")
        return inside, deeper - (not inside)

    def cut(self, state: int, depth: int, texts: Iterator[str]) -> Iterator[tuple[bool, bool, str]]:
        head, kept = bool(state or depth > 1), []
        for text in texts:
            state, deeper = self.after(state, text)
            depth += deeper
            if not kept and not head:
                begin = self._between.match(text).end()
                if begin == len(text):
                    continue  # the end of the array
                if text[begin] != "{":
                    raise ValueError(f"not an array of records: {text[begin : begin + 40]!r}")
                text = text[begin:]
            kept.append(text + "}")
            if not state and depth <= 1:
                yield head, False, "".join(kept)
                head, kept = False, []
        if kept:
            yield head, True, "".join(kept)


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(first row, end) of the rows of one byte range."""
    ends = set()
    for name in ("file", "start"):
        ends |= set(pc.run_end_encode(batch[name]).run_ends.to_pylist())
    at = 0
    for end in sorted(ends):
        yield at, end
        at = end


def ranged(spark: SparkSession, path: str | Sequence[str], break_at: str) -> DataFrame:
    """Rows (file, start, value): text cut at ``break_at``, and the byte range that each piece is read in."""
    text = spark.read.option("lineSep", break_at).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def first_states(text: DataFrame, kind: QuotedLines | JsonArray) -> DataFrame:
    """Rows (file, start, state, depth): the state that each byte range begins in; one row per range."""
    ddl = "file string, start bigint, s0 int, d0 int, s1 int, d1 int"

    def transfers(batches):
        key, ends = None, None

        def row():
            return pa.RecordBatch.from_pydict(
                {"file": [key[0]], "start": [key[1]], **{c: pa.array([v], pa.int32()) for c, v in zip(("s0", "d0", "s1", "d1"), ends[0] + ends[1])}})

        for batch in batches:
            for at, end in runs_of(batch):
                here = batch["file"][at].as_py(), batch["start"][at].as_py()
                if here != key:
                    if key:
                        yield row()
                    key, ends = here, [[0, 0], [1, 0]]
                for value in batch["value"].slice(at, end - at).to_pylist():
                    for e in ends:
                        e[0], deeper = kind.after(e[0], value)
                        e[1] += deeper
        if key:
            yield row()

    def composed(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges = ranges.sort_values("start")
        state, depth, out = 0, 0, []
        for s0, d0, s1, d1 in ranges[["s0", "d0", "s1", "d1"]].itertuples(index=False):
            out.append((state, depth))
            state, depth = (s1, depth + d1) if state else (s0, depth + d0)
        found = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"file": ranges["file"], "start": ranges["start"], "state": found[:, 0], "depth": found[:, 1]})

    return text.mapInArrow(transfers, ddl).groupBy("file").applyInPandas(composed, "file string, start bigint, state int, depth int")


def records(spark: SparkSession, path: str | Sequence[str], kind: QuotedLines | JsonArray) -> DataFrame:
    """Rows (file, start, seq, text): the records of the files, in order by (file, start, seq).

    The text is read twice, for the states and for the records, and written
    once. A record as large as several ranges is joined in one task.
    """
    text = ranged(spark, path, kind.break_at)
    # one row of two integers and a name per task of the scan, so always small enough to broadcast
    states = stage(first_states(text, kind))
    known = text.join(F.broadcast(states), ["file", "start"])

    def cut(batches):
        rows = []

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
            rows.clear()
            return out

        for (file, start), pieces in _by_range(batches, kind):
            for seq, piece in enumerate(pieces):
                rows.append((file, start, seq, *piece))
                if len(rows) == _ROWS:
                    yield batch_of()
        if rows:
            yield batch_of()

    pieces = stage(known.mapInArrow(cut, PIECES))
    crossing = pieces.filter("head or open")
    order = W.partitionBy("file").orderBy("start", "seq")
    numbered = crossing.withColumn("record", F.sum((~F.col("head")).cast("bigint")).over(order))
    joined = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"), F.array_join("p.text", kind.joint).alias("text"))
    return pieces.filter("not head and not open").select("file", "start", "seq", "text").unionByName(joined)


def _by_range(batches, kind):
    """((file, start), its pieces) for each byte range in Arrow batches; the pieces must be read before the next range."""

    def values():
        for batch in batches:
            for at, end in runs_of(batch):
                first = batch.slice(at, 1).to_pylist()[0]
                key = first["file"], first["start"], first["state"], first["depth"]
                for value in batch["value"].slice(at, end - at).to_pylist():
                    yield key, value

    for (file, start, state, depth), group in itertools.groupby(values(), key=lambda v: v[0]):
        yield (file, start), kind.cut(state, depth, (value for _, value in group))
