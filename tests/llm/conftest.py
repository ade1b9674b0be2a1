from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators might use themselves
    T.StructField("id", T.StringType()), T.StructField("size", T.LongType()), T.StructField("component", T.StringType()),
])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):x}o" for _ in range(n))


def make_texts(seed=7):
    """Nulls, empty, blank, long, repeated, near copies, shared passages, other scripts."""
    rng = random.Random(seed)
    passage = words(rng, 130)
    base = words(rng, 150)
    texts = [None, "", "   \n\t", "a", "été 日本語 ñ 🎉", base, base, base.replace("w1", "W1"), words(rng, 6000), "x" * 1500, "ab" * 700]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, rng.randrange(40)) for _ in range(4)]
    for _ in range(12):
        near = base.split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += ["\n".join([words(rng, 12)] * 8), "line one\nline one\n\n line two\x1cx\nline one"]
    texts += [words(rng, rng.randrange(5, 300)) for _ in range(30)]
    texts += ["### " * 60, "SHOUT LOUD! " * 50, passage, "é" * 500 + passage]
    return texts


@pytest.fixture(scope="session")
def rows():
    out = []
    for i, t in enumerate(make_texts()):
        out.append((i if i != 20 else None, t, ["en", "fr", None][i % 3], ["a", "b", "b", "c", None][i % 5], len(t or ""), "x", 3, "y"))
    out += [out[12], out[12]]  # repeated rows
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
