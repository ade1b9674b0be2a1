"""Language identification by nearest centroid over TF-IDF vectors of character n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import held, in_slices, quoted, text_of

DIMENSIONS = 4096
CENTROIDS = 4
# Centroids are fitted on about so many documents, shared evenly by the languages; everything counted covers all.
SAMPLE = 2000
LEAST = 20
REJECT_SHARE = 0.005
UNKNOWN = "und"


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    limit: np.ndarray


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of a text in lower case, other characters read as spaces; None without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = held("letters", _letters)
    is_letter = letters[np.minimum(code, 0xFFFF)]
    for place in np.flatnonzero(code > 0xFFFF).tolist():
        is_letter[place] = chr(int(code[place])).isalpha()
    if not is_letter.any():
        return None
    c = np.where(is_letter, code, 32).astype(np.uint64)
    c = np.r_[np.uint64(32), c, np.uint64(32)]
    keep = ~((c[1:] == 32) & (c[:-1] == 32))  # runs of spaces are one
    c = c[np.r_[True, keep]]
    out = np.zeros(DIMENSIONS)
    h = c * np.uint64(0x9E3779B97F4A7C15)
    for n in range(3):
        if n:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + c[n:]
            h *= np.uint64(0x94D049BB133111EB)
        out += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    return out


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit(""))) % 5 == 0


def clusters(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids of unit vectors by cosine; the first is the mean's nearest, each next the vector least like those before."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centre = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, 1)
        after = np.array([x[own == j].mean(0) if (own == j).any() else centre[j] for j in range(len(centre))])
        after /= np.maximum(np.linalg.norm(after, axis=1, keepdims=True), 1e-12)
        if np.allclose(after, centre):
            break
        centre = after
    return centre


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from documents with a language that are not held out."""
    train = docs.select(quoted(lang_col).alias("lang"), text_of(docs, text_col).alias("text"), quoted(id_col).alias("id"))
    train = train.filter(~held_out("id") & F.col("lang").isNotNull())

    def document_frequency(batches):
        seen, n = np.zeros(DIMENSIONS), {}
        for b in in_slices(batches):
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
                tf = counts(text)
                if tf is not None:
                    seen += tf > 0
                    n[lang] = n.get(lang, 0) + 1
        for lang, many in n.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([-1]), pa.array([float(many)])], ["lang", "dim", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([""] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(seen)], ["lang", "dim", "n"])

    sums = train.select("text", "lang").mapInArrow(document_frequency, "lang string, dim bigint, n double").groupBy("lang", "dim").agg(
        F.sum("n").alias("n")).collect()  # DIMENSIONS rows and one per language
    size = {r["lang"]: r["n"] for r in sums if r["dim"] < 0}
    seen = np.zeros(DIMENSIONS)
    for r in sums:
        if r["dim"] >= 0:
            seen[r["dim"]] = r["n"]
    idf = np.log((1 + sum(size.values())) / (1 + seen)) + 1
    languages = sorted(size)
    if not languages:
        return Model(idf, [], np.zeros(0, int), np.zeros((0, DIMENSIONS)), np.zeros(0))
    share = max(LEAST, SAMPLE // len(languages))
    cut = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(1e6 * min(1.0, share / size[lang])))])
    picked = train.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < cut[F.col("lang")])

    def vectors(batches):
        for b in in_slices(batches):
            pairs = [(lang, counts(t)) for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist())]
            pairs = [(lang, unit(tf, idf).astype(np.float32).tobytes()) for lang, tf in pairs if tf is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())], ["lang", "v"])

    sample: dict[str, list] = {lang: [] for lang in languages}
    for r in picked.select("text", "lang").mapInArrow(vectors, "lang string, v binary").toLocalIterator():
        sample[r["lang"]].append(np.frombuffer(r["v"], np.float32))
    owner, centroids, limit = [], [], []
    for i, lang in enumerate(languages):
        if not sample[lang]:
            continue
        x = np.array(sample[lang], np.float64)
        found = clusters(x, CENTROIDS)
        likeness = x @ found.T
        own = np.argmax(likeness, 1)
        for j in range(len(found)):
            inside = likeness[own == j, j]
            limit.append(float(np.quantile(inside, REJECT_SHARE)) if len(inside) else 1.0)
        owner += [i] * len(found)
        centroids.append(found)
    return Model(idf, languages, np.array(owner, int), np.concatenate(centroids) if centroids else np.zeros((0, DIMENSIONS)), np.array(limit))


PREDICTED = "id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, lang_pred, score, rejected) of every whole text.

    ``score`` is the cosine to the nearest centroid. ``rejected`` says that the
    text is further from it than nearly all that the centroid was made from.
    A null text and one without a letter are ``und`` with score 0, as is every
    text if nothing was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        m = sent.value
        for b in in_slices(batches):
            tf = [counts(t) for t in b["text"].to_pylist()]
            n = len(tf)
            lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            some = [i for i, v in enumerate(tf) if v is not None] if len(m.owner) else []
            if some:
                likeness = unit(np.array([tf[i] for i in some]), m.idf) @ m.centroids.T
                best = np.argmax(likeness, 1)
                top = likeness[np.arange(len(some)), best]
                score[some], rejected[some] = np.clip(top, 0, 1), top < m.limit[best]
                for i, c in zip(some, best.tolist()):
                    lang[i] = m.languages[m.owner[c]]
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(lang), pa.array(score), pa.array(rejected)], schema=schema)

    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), held_out(id_col).alias("held_out"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, PREDICTED)
