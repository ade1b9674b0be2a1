"""Toxic passages as maximum-scoring segments of token log-odds.

A token scores by how much likelier a toxic document holds it, with Dirichlet
priors in proportion to its frequency, less a drift that makes ordinary text
score below zero. One linear scan finds every maximal segment of a text. The
scores of such segments in clean text follow an extreme-value law, which gives
each an expected number of chance finds; a document's evidence is the sum over
its significant segments, and a logistic curve turns it into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import held, in_slices, quoted, text_of

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 18
# The model is fitted on at most about so many labelled documents, chosen by a hash of their id.
LABELLED = 60_000
PRIOR_SHARE = 0.1
BOUND = 4.0
DRIFT = 0.7
SIGNIFICANT = 0.1
EULER = 0.5772156649


@dataclass
class Model:
    score: np.ndarray
    rate: float
    log_k: float
    slope: float
    offset: float


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) & (BUCKETS - 1)


def buckets(text: str) -> np.ndarray:
    known = held("toxicity tokens", dict)
    if len(known) > 500_000:
        known.clear()
    out = []
    for t in TOKEN.findall(text.lower()):
        b = known.get(t)
        if b is None:
            b = known[t] = bucket_of(t)
        out.append(b)
    return np.array(out, np.int64)


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Token scores: the cautious end of the log-odds' interval, less the drift."""
    both = toxic + clean
    total = max(both.sum(), 1.0)
    prior = both / total * PRIOR_SHARE * total + 1e-3
    a, b = toxic + prior * toxic.sum() / total, clean + prior * clean.sum() / total
    a, b = a + 1e-3, b + 1e-3
    ratio = np.log(a / max(a.sum(), 1e-9)) - np.log(b / max(b.sum(), 1e-9))
    sure = np.maximum(np.abs(ratio) - BOUND * np.sqrt(1 / a + 1 / b), 0) * np.sign(ratio)
    return np.maximum(sure, 0) - DRIFT


def decay(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum p exp(rate * score) = 1, by bisection."""
    p = weight / max(weight.sum(), 1e-9)
    value, at = np.unique(np.round(score, 3), return_inverse=True)
    p = np.bincount(at, p, len(value))
    if not (p[value > 0].sum() > 0) or p @ value >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while p @ np.exp(high * value) < 1 and high < 50:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if p @ np.exp(middle * value) < 1 else (low, middle)
    return high


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) in one linear pass."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    after = np.cumsum(scores)
    found: list[list] = []  # first, end, total before, total after, nearest earlier one that starts lower
    for i in places.tolist():
        new = [i, i + 1, float(after[i] - scores[i]), float(after[i]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


def held_out(id_col: str, rest: int = 1, of: int = 3) -> Column:
    return F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit(""))) % of == rest


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from labelled documents that are not held out. Repeated labels of an id count as one, the highest."""
    chosen = labels.filter(~held_out(id_col) & quoted(label_col).isNotNull()).groupBy(quoted(id_col).alias("__id")).agg(
        F.max(quoted(label_col)).cast("int").alias("__toxic"))
    n = chosen.count()
    if n > LABELLED:
        chosen = chosen.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * LABELLED / n)))
    # at most about LABELLED rows of two numbers
    train = docs.select(quoted(id_col).alias("__id"), text_of(docs, text_col).alias("text")).join(F.broadcast(chosen), "__id").select("text", "__toxic")

    def count(batches):
        sums = np.zeros((2, BUCKETS))
        for b in in_slices(batches):
            for text, label in zip(b["text"].to_pylist(), b["__toxic"].to_pylist()):
                sums[int(label > 0), np.unique(buckets(text))] += 1
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["bucket", "clean", "toxic"])

    rows = train.mapInArrow(count, "bucket bigint, clean double, toxic double").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()  # at most BUCKETS rows
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        clean[r["bucket"]], toxic[r["bucket"]] = r["clean"], r["toxic"]
    score = log_odds(toxic, clean)
    rate = decay(score, clean)
    sent = docs.sparkSession.sparkContext.broadcast(score)

    def parts_of(text: str) -> tuple[int, list[float]]:
        s = sent.value[buckets(text)]
        return len(s), [x[2] * rate for x in segments(s)]

    def measure(batches):
        for b in in_slices(batches):
            n, best = [], []
            for text in b["text"].to_pylist():
                size, parts = parts_of(text)
                n.append(size), best.append(max(parts, default=0.0))
            yield pa.RecordBatch.from_arrays([b["__toxic"], pa.array(n), pa.array(best)], ["toxic", "n", "best"])

    seen = train.mapInArrow(measure, "toxic int, n bigint, best double").collect()  # the sample's rows
    ordinary = [r["best"] - math.log(max(r["n"], 1)) for r in seen if not r["toxic"] and r["best"] > 0]
    log_k = float(np.mean(ordinary)) - EULER if ordinary else 0.0

    def weigh(batches):
        for b in in_slices(batches):
            x = []
            for text in b["text"].to_pylist():
                size, parts = parts_of(text)
                x.append(evidence(parts, size, log_k))
            yield pa.RecordBatch.from_arrays([b["__toxic"], pa.array(x, pa.float64())], ["toxic", "x"])

    seen = train.mapInArrow(weigh, "toxic int, x double").collect()  # the evidence of all segments, as in score()
    x = np.array([r["x"] for r in seen])
    slope, offset = logistic(x, np.array([r["toxic"] > 0 for r in seen], float))
    return Model(score.astype(np.float32), rate, log_k, slope, offset)


def expected(found: float, n: int, log_k: float) -> float:
    """Log of the number of segments at least as good that chance makes in a clean text of ``n`` tokens."""
    return log_k + math.log(max(n, 1)) - found


def evidence(found: list[float], n: int, log_k: float) -> float:
    limit = math.log(SIGNIFICANT)
    return math.log1p(sum(max(limit - expected(s, n, log_k), 0.0) for s in found))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    if not len(x):
        return 1.0, 0.0
    a, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


SCORED = "id bigint, held_out boolean, score double, predicted int, passages array<struct<begin:int,end:int,expected:double>>"
PASSAGE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows (id, held_out, score, predicted, passages) of every whole text.

    ``passages`` are the significant segments as character ranges with the
    number of such finds that chance explains. A null or empty text has no
    evidence and gets the score of that. A null id counts as an empty one
    for ``held_out``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", PASSAGE)])

    def run(batches):
        m, limit = sent.value, math.log(SIGNIFICANT)
        for b in in_slices(batches):
            scores, passages = [], []
            for text in b["text"].to_pylist():
                s = m.score[buckets(text)].astype(np.float64)
                found = segments(s)
                x = evidence([v * m.rate for _, _, v in found], len(s), m.log_k)
                scores.append(1 / (1 + math.exp(-max(min(m.slope * x + m.offset, 30), -30))))
                sure = [(a, e, lg) for a, e, v in found if (lg := expected(v * m.rate, len(s), m.log_k)) < limit]
                places = [t.span() for t in TOKEN.finditer(text)] if sure else []
                if len(places) != len(s):  # lower case changed the token borders: no character ranges
                    places = [(-1, -1)] * len(s)
                passages.append([{"begin": places[a][0], "end": places[e - 1][1], "expected": math.exp(lg)} for a, e, lg in sure])
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["held_out"], pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(passages, PASSAGE)], schema=schema)

    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), held_out(id_col).alias("held_out"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, SCORED)
