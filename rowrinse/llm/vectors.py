"""Near-duplicate vectors by p-stable hashing and exact cosines.

Vectors of length one are projected on Gaussian directions and quantised; the
values of several directions together are a bucket, and there are several
tables of buckets. Two vectors that meet in a bucket are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import Stages, block_pairs, components, in_slices, local_components, partitions, quoted, spread

WIDTH = 2.0
MISS = 0.01
SHARD = 512
# Blocks of up to so many vectors are compared pair by pair, all at once.
FEW = 64
TOGETHER = 400_000
SEED = 20_240_601


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points so far apart share the quantised value of one direction."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, cosine: float) -> tuple[int, int]:
    """Directions per table and tables: about thirty strangers to a bucket, and at most ``MISS`` missed at the threshold itself."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 60) / 30) / -math.log(far)))
    return k, max(1, math.ceil(math.log(MISS) / math.log(1 - near**k)))


def signatures(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket numbers of unit vectors, one column per table."""
    rng = np.random.default_rng(SEED + x.shape[1])
    directions = rng.standard_normal((x.shape[1], k * tables))
    shift = rng.uniform(0, WIDTH, k * tables)
    mix = rng.integers(1, 1 << 62, k * tables, dtype=np.int64) | 1
    out = []
    for at in range(0, len(x), 4096):
        value = np.floor((x[at : at + 4096] @ directions + shift) / WIDTH).astype(np.int64)
        out.append((value * mix).reshape(len(value), tables, k).sum(2))
    return np.concatenate(out) if out else np.zeros((0, tables), np.int64)


def usable(c: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit_rows(data) -> np.ndarray:
    data = list(data)
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_pairs_of(x: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float):
    """Row pairs (i, j), i before j, of one block each, a left and a right one, whose cosine reaches the threshold."""
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, len(block)])
    for at, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        a, b = at + np.flatnonzero(left[at : at + m]), at + np.flatnonzero(right[at : at + m])
        i, j = np.nonzero(x[a] @ x[b].T >= cosine)
        i, j = a[i], b[j]
        low, high = np.minimum(i, j), np.maximum(i, j)
        pairs = np.unique(np.c_[low, high][low < high], axis=0)
        yield pairs[:, 0], pairs[:, 1]
    some = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    ends = np.repeat(starts + sizes, sizes)[some]
    upto = np.cumsum(ends - some - 1)
    cuts = np.searchsorted(upto, np.arange(TOGETHER, (upto[-1] if len(upto) else 0) + TOGETHER, TOGETHER))
    for a, b in zip(np.r_[0, cuts[:-1] + 1], cuts + 1):
        own = some[a:b]
        owner, j = spread(own + 1, ends[a:b] - own - 1)
        i = own[owner]
        meet = (left[i] & right[j]) | (left[j] & right[i])
        i, j = i[meet], j[meet]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        yield i[near], j[near]


def compared(rows: pd.DataFrame, cosine: float, k: int, tables: int) -> pd.DataFrame:
    """Links of the blocks of a task: per class their weight, of pairs first met here, and a class it is joined to."""
    rows = rows.sort_values("block", ignore_index=True)
    x = unit_rows(rows["v"])
    found = list(block_pairs_of(x, rows["block"].to_numpy(), rows["left"].to_numpy(), rows["right"].to_numpy(), cosine))
    i, j = (np.concatenate([f[side] for f in found]) if found else np.zeros(0, int) for side in (0, 1))
    value, cls = np.unique(rows["cls"].to_numpy(), return_inverse=True)
    i, j = i[cls[i] != cls[j]], j[cls[i] != cls[j]]
    touched = np.unique(np.r_[i, j])
    sig = signatures(x[touched], k, tables)
    place = np.zeros(len(rows), int)
    place[touched] = np.arange(len(touched))
    table, many = rows["t"].to_numpy(), rows["n"].to_numpy()
    links = np.zeros(len(value), np.int64)
    for at in range(0, len(i), 16384):
        a, b = i[at : at + 16384], j[at : at + 16384]
        first = np.argmax(sig[place[a]] == sig[place[b]], axis=1) == table[a]
        np.add.at(links, cls[a[first]], many[b[first]])
        np.add.at(links, cls[b[first]], many[a[first]])
    label = local_components(len(value), cls[i], cls[j])
    some = np.unique(np.r_[cls[i], cls[j]])
    return pd.DataFrame({"cls": value[some], "links": links[some], "root": value[label[some]]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Rows (id, n_links, component, kept): links are pairs with a cosine of at least ``cosine``.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, nor do vectors of different lengths. Equal vectors are
    one class with a count, so copies cost one row. A null id never names a
    component. A pair that meets in several tables counts in the first.
    """
    spark = df.sparkSession
    stages = Stages(spark)
    v = quoted(vector_col).cast("array<double>")
    rows = df.select(quoted(id_col).cast("bigint").alias("id"), F.when(usable(v), v).alias("v"))
    rows = rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64(F.size("v"), "v")))
    grouped = rows.filter("v is not null").groupBy("cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # one vector of each class: equal ones are equal whichever is taken
    picked = rows.filter("v is not null").dropDuplicates(["cls"]).select("cls", "v")

    def pack(batches):
        for b in in_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b["cls"], pa.array([np.array(x, "<f8").tobytes() for x in b["v"].to_pylist()], pa.binary())], ["cls", "v"])

    data = stages(picked.mapInArrow(pack, "cls bigint, v binary").join(grouped, "cls"))
    n = data.count()
    k, tables = tables_for(n, cosine)

    def bucket(batches):
        for b in in_slices(batches, 2048):
            cls, vectors = b["cls"].to_numpy(), b["v"].to_pylist()
            for size in {len(x) for x in vectors}:
                some = [i for i, x in enumerate(vectors) if len(x) == size]
                found = signatures(unit_rows([vectors[i] for i in some]), k, tables)
                owner = np.repeat(cls[some], tables)
                table = np.tile(np.arange(tables, dtype=np.int32), len(some))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(table), pa.array(found.ravel() * 1_000_003 + size)], ["cls", "t", "bucket"])

    keyed = stages(data.select("cls", "v").mapInArrow(bucket, "cls bigint, t int, bucket bigint").select(
        "cls", "t", F.xxhash64("t", "bucket").alias("key")))
    blocks = block_pairs(keyed, "key", "cls", SHARD)
    tasks = partitions(spark, n * tables, 20_000)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [compared(part, cosine, k, tables) for _, part in rows.groupby(rows["v"].map(len))]
        return pd.concat(parts) if parts else pd.DataFrame({"cls": [], "links": [], "root": []}, dtype="int64")

    met = blocks.join(data.select("cls", "v", "n"), "cls").withColumn("task", F.pmod(F.col("block"), F.lit(tasks)).cast("int"))
    found = stages(met.groupBy("task").applyInPandas(compare, "cls bigint, links bigint, root bigint"))
    reached = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), stages)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per = data.select("cls", "first", "n").join(links, "cls", "left").join(reached.withColumnRenamed("node", "cls"), "cls", "left")
    per = per.withColumn("root", F.coalesce("component", "cls")).drop("component")
    least = per.groupBy("root").agg(F.min("first").alias("component"))
    named = stages(per.join(least, "root").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"))
    stages.close(keep=(named,))
    joined = rows.select("id", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
