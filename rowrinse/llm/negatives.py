"""Hard negatives by inner product: buckets of like length, sorted coordinates, feasible ranges.

Vectors are ranked by length within each label and cut into blocks. A task
holds one block of anchors and one block of vectors, the latter in buckets of
like length, longest first. For an anchor and the score it has to reach, a
bucket's greatest length gives the cosine that is needed. From this follows,
for each of the anchor's largest coordinates, the range in which that
coordinate of a fitting vector must lie. The ranges are looked up in sorted
coordinate lists; what is in all of them is scored exactly.

The blocks are worked off in waves of growing number, longest vectors first.
After each wave the score to reach is what the best found so far demand, so a
later wave adds few rows. No wave leaves out a vector that could count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowrinse.llm.common import Stages, in_slices, quoted
from rowrinse.llm.merkle import numbered

SCALE = 256
BUCKET = 512
SHORTER = 0.9
FOCUS = 3
BLOCK_ROWS = 32_768
ANCHOR_ROWS = 4096
WAVE, GROWTH = 16, 8
LARGEST = 1 << 62
NONE = -(1 << 63)


class Bucket:
    """Vectors of like length with, for each coordinate asked for, its values in order.

    ``unit`` are the directions; lists are made when first asked for.
    """

    def __init__(self, rows: np.ndarray, unit: np.ndarray, longest: float):
        self.rows, self.unit, self.longest = rows, unit, longest
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sorted_by(self, c: int):
        if c not in self.lists:
            order = np.argsort(self.unit[:, c], kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            self.lists[c] = self.unit[order, c], order, rank
        return self.lists[c]

    def candidates(self, focus: list[int], direction: np.ndarray, cosine: float) -> np.ndarray:
        """The rows that may have a cosine of at least ``cosine`` to ``direction``, by its ``focus`` coordinates.

        With the angles a of direction to the axis and b of the cosine, the
        angle of a fitting vector to the axis is between a - b and a + b.
        """
        if cosine > 1:
            return self.rows[:0]
        if cosine <= -1:
            return self.rows
        reach = math.acos(cosine)
        spans = []
        for c in focus:
            angle = math.acos(min(1.0, max(-1.0, direction[c])))
            low = -2.0 if angle + reach >= math.pi else math.cos(angle + reach)
            high = 2.0 if angle - reach <= 0 else math.cos(angle - reach)
            values = self.sorted_by(c)[0]
            spans.append((np.searchsorted(values, low - 1e-9, "left"), np.searchsorted(values, high + 1e-9, "right"), c))
        spans.sort(key=lambda s: s[1] - s[0])
        low, high, c = spans[0]
        found = self.lists[c][1][low:high]
        for low, high, c in spans[1:]:
            rank = self.lists[c][2][found]
            found = found[(rank >= low) & (rank < high)]
        return self.rows[found]


class Index:
    """Integer vectors of one block in buckets, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        floats = vectors.astype(np.float64)
        length = np.sqrt((floats**2).sum(1))
        self.bound = float(np.abs(floats).max(initial=0))
        # exact in doubles as long as all sums are below 2^53, else in Python's integers
        self.floats, self.whole = floats, vectors
        order = np.lexsort((ids, -length))
        self.buckets = []
        at = 0
        while at < len(order):
            longest = length[order[at]]
            end = at + int(np.searchsorted(-length[order[at : at + BUCKET]], -SHORTER * longest, "right"))
            rows = order[at : max(end, at + 1)]
            unit = floats[rows] / np.maximum(length[rows], 1e-300)[:, None]
            self.buckets.append(Bucket(rows, unit, longest))
            at += len(rows)

    def scores(self, rows: np.ndarray, query: np.ndarray):
        if self.bound * float(np.abs(query.astype(np.float64)).max(initial=0)) * len(query) < 2**53:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        exact = self.whole[rows].astype(object) @ query.astype(object)
        return np.clip(exact, NONE, -NONE - 1).astype(np.int64)

    def best(self, query: np.ndarray, asks: list[tuple[int, int, int]], k: int, without: int | None = None):
        """For each ask (least, most, score to reach): the first ``k`` (score, id) in least .. most, best first.

        An ask needs at least its third number, which is what ``k`` rows found elsewhere have already.
        Rows with the id ``without`` are passed over.
        """
        floats = query.astype(np.float64)
        length = math.sqrt(float((floats**2).sum()))
        direction = floats / length if length else floats
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS].tolist()
        score = [np.zeros(0, np.int64) for _ in asks]
        ident = [np.zeros(0, np.int64) for _ in asks]
        need = [max(least, reach) for least, _, reach in asks]
        for bucket in self.buckets:
            wanted = min(need)
            top = length * bucket.longest
            if top:
                # a little below, for the roundings of the bound
                cosine = wanted / top - 1e-9
                if cosine > 1 and wanted > 0:
                    break  # the rest is shorter
                rows = bucket.candidates(focus, direction, cosine) if wanted > 0 else bucket.rows
            else:
                rows = bucket.rows
            if not len(rows):
                continue
            found, ids = self.scores(rows, query), self.ids[rows]
            if without is not None:
                other = ids != without
                found, ids = found[other], ids[other]
            for j, (_, most, _) in enumerate(asks):
                ok = (found >= need[j]) & (found <= most)
                if not ok.any():
                    continue
                s, i = np.r_[score[j], found[ok]], np.r_[ident[j], ids[ok]]
                first = np.lexsort((i, -s))[:k]
                score[j], ident[j] = s[first], i[first]
                if len(first) == k:
                    need[j] = max(need[j], int(s[first[-1]]))
        return list(zip(score, ident))


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, size, v, length): components times 256 rounded down, as packed 64-bit integers.

    Rows with a null id, label or vector and those with a null or non-finite
    component are left out. Components are held within 2^62.
    """
    v = quoted(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & F.coalesce(good, F.lit(False))).select(
        quoted(id_col).cast("bigint").alias("id"), quoted(label_col).cast("bigint").alias("label"), v.alias("v"))
    ddl = "id bigint, label bigint, size int, v binary, length double"
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("v", pa.binary()), ("length", pa.float64())])

    def pack(batches):
        for b in in_slices(batches, 2048):
            sizes, packed, lengths = [], [], []
            for x in b["v"].to_pylist():
                whole = np.clip(np.floor(SCALE * np.array(x, np.float64)), -float(LARGEST), float(LARGEST))
                sizes.append(len(x)), packed.append(whole.astype("<i8").tobytes()), lengths.append(float(np.sqrt((whole**2).sum())))
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["label"], pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(lengths)], schema=schema)

    return rows.mapInArrow(pack, ddl)


def waves(blocks: int) -> list[tuple[int, int]]:
    """Ranges of block numbers, each several times the one before."""
    out, at, wide = [], 0, WAVE
    while at < blocks:
        out.append((at, at + wide))
        at, wide = at + wide, wide * GROWTH
    return out


def searched(asks: DataFrame, data: DataFrame, blocks: list[tuple], k: int, same_label: bool, stages: Stages) -> DataFrame:
    """The first ``k`` rows (anchor, ask, found, score) for each ask (anchor, anchor_id, ask, label, size, least, most, part, v).

    ``data`` has (id, label, size, v, block), ``blocks`` rows (size, label, block, number), the number counted
    over all labels from the longest vectors on. Ranks go by score, then id.
    """
    width = 1 + max((b[3] for b in blocks), default=0)
    best = None
    for low, high in waves(width):
        here = [b for b in blocks if low <= b[3] < high]
        listed = asks.sparkSession.createDataFrame(
            pd.DataFrame({"b_size": [b[0] for b in here], "b_label": [b[1] for b in here], "block": [b[2] for b in here]}),
            "b_size int, b_label bigint, block bigint")
        # a row per kind of anchors and block, however many anchors there are
        kinds = asks.select("part", "label", "size").distinct()
        meets = (F.col("label") == F.col("b_label")) if same_label else (F.col("label") != F.col("b_label"))
        pairs = stages(kinds.join(listed, (F.col("size") == F.col("b_size")) & meets).select("part", "label", "size", "b_label", "block"))
        rows = asks
        if best is not None:
            reach = best.groupBy("anchor", "ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(F.col("n") == k)
            rows = asks.join(reach.select("anchor", "ask", F.col("low").alias("reach")), ["anchor", "ask"], "left")
        else:
            rows = asks.withColumn("reach", F.lit(None).cast("bigint"))
        left = rows.groupBy("part", "label", "size", "anchor", "anchor_id", "v").agg(
            F.array_sort(F.collect_list(F.struct("ask", "least", "most", F.coalesce("reach", F.lit(NONE)).alias("reach")))).alias("asks"))
        left = left.join(pairs, ["part", "label", "size"])
        wanted = pairs.select("part", "size", F.col("b_label").alias("label"), "block").distinct()
        right = data.join(wanted, ["size", "label", "block"]).select("part", "size", "label", "block", "id", "v")

        def search(anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
            out = {"anchor": [], "ask": [], "found": [], "score": []}
            if len(anchors) and len(vectors):
                width = len(vectors["v"].iloc[0]) // 8
                index = Index(vectors["id"].to_numpy(), np.frombuffer(b"".join(vectors["v"]), "<i8").reshape(len(vectors), width))
                for anchor, own, v, asked in zip(anchors["anchor"], anchors["anchor_id"], anchors["v"], anchors["asks"]):
                    wanted = [(a["least"], a["most"], a["reach"]) for a in asked]
                    for a, (score, ids) in zip(asked, index.best(np.frombuffer(v, "<i8"), wanted, k, own if same_label else None)):
                        out["anchor"] += [anchor] * len(ids)
                        out["ask"] += [a["ask"]] * len(ids)
                        out["found"] += ids.tolist()
                        out["score"] += score.tolist()
            return pd.DataFrame(out, columns=list(out)).astype("int64")

        block = ("part", "size", "b_label", "block")
        new = left.groupBy(*block).cogroup(right.groupBy("part", "size", "label", "block")).applyInPandas(search, "anchor bigint, ask bigint, found bigint, score bigint")
        both = new if best is None else best.select("anchor", "ask", "found", "score").unionByName(new)
        first = W.partitionBy("anchor", "ask").orderBy(F.col("score").desc(), "found")
        best = stages(both.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k))
    return best


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, anchor_every: int = 100,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``anchor_every`` divides. The positives of an
    anchor are the first other rows of its label, its negatives the first rows
    of other labels with ``least`` % to ``most`` % of the positive's score; in
    all ranks ties go by id. A positive with a negative score has no such row.

    Rows with a null id, label, vector or component and those with non-finite
    components take no part. Vectors meet only vectors of the same number of
    components; zero and empty ones score zero. Rows that repeat an id count
    each, but are no positives of an anchor of that id. Scores beyond a long are cut to it. An empty table gives an empty result.
    """
    spark = df.sparkSession
    stages = Stages(spark)
    rows = quantised(df, id_col, vector_col, label_col)
    # by length within each label; the order of labels is that of the blocks
    rows = rows.select("*", F.struct("size", "label").alias("group"), (-F.col("length")).alias("short"))
    placed, sizes = numbered(rows, "group", ["short", "id", "v"], stages)
    data = stages(placed.select("id", "label", "size", "v", F.floor(F.col("place") / BLOCK_ROWS).cast("bigint").alias("block")))
    # a row per block, of which there is one in 32,768 vectors or one of a label
    per = sizes.select("group.size", "group.label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK_ROWS))).alias("block"))
    listed = sorted(((r["size"], r["label"], r["block"]) for r in per.collect()), key=lambda b: (b[2], b[0], b[1]))
    blocks = [(*b, k) for k, b in enumerate(listed)]

    anchors = data.filter(F.col("id") % anchor_every == 0).select(
        F.xxhash64("id", "label", "v").alias("anchor"), F.col("id").alias("anchor_id"), "label", "size", "v").distinct()
    count = max(1, -(-anchors.count() // ANCHOR_ROWS))
    asks = stages(anchors.withColumn("part", F.pmod(F.col("anchor"), F.lit(count)).cast("int")))
    wide = asks.select("*", F.lit(0).cast("bigint").alias("ask"), F.lit(NONE).alias("least"), F.lit(-NONE - 1).alias("most"))
    empty = spark.createDataFrame([], "anchor bigint, ask bigint, found bigint, score bigint, rank int")
    good = searched(wide, data, blocks, positives, True, stages) or empty
    # scores between two whole numbers of hundredths, rounded inwards
    score = F.col("score").cast("decimal(20,0)")
    low, high = F.ceil(score * least / 100).cast("bigint"), F.floor(score * most / 100).cast("bigint")
    ranged = asks.join(good.select("anchor", "found", "score", F.col("rank").cast("bigint").alias("ask")), "anchor").select(
        *asks.columns, "found", "score", "ask", low.alias("least"), high.alias("most")).filter("least <= most")
    ranged = stages(ranged)
    bad = searched(ranged, data, blocks, negatives, False, stages) or empty
    named = good.join(asks.select("anchor", "anchor_id"), "anchor").select("anchor", "anchor_id", F.col("rank").cast("bigint").alias("ask"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(named, ["anchor", "ask"]).select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
