"""Helpers shared by the operators: shared folder, batches, hashing folds, connected components."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
ROWS = 256
RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; one under the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, through the file system that Spark uses."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go with its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(RELEASED, None)
    spark.conf.set(RELEASED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASED)
        else:
            spark.conf.set(RELEASED, before)


class Stages:
    """Tables written to the shared folder so that work above them is done once.

    A lost executor costs a reread, and a table that is written needs the
    shuffle files it came from no longer. ``close`` removes all but the tables
    named in ``keep``, which the caller's result still reads.
    """

    def __init__(self, spark: SparkSession, codec: str | None = None):
        self.spark, self.folder, self.names = spark, shared_folder(spark), []
        self.options = {"compression": codec} if codec else {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.names)}"
        self.names.append(path)
        schema = df.schema
        with released_shuffles(self.spark):
            df.write.options(**self.options).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t.staged_at)

    def close(self, keep: tuple[DataFrame, ...] = ()) -> None:
        kept = {t.staged_at for t in keep}
        for path in self.names:
            if path not in kept:
                remove(self.spark, path)


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for so many rows: in proportion to them, and at least as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(df: DataFrame, column: str) -> Column:
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def held(key, make: Callable):
    """``make()``, kept for the life of a Python worker; functions that arrive by value have no lasting globals."""
    kept = sys.modules.setdefault("_llm_held", types.ModuleType("_llm_held")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(make: Callable, schema: str | pa.Schema, rows: int = ROWS):
    """An Arrow map function from ``make(batch) -> dict of columns``."""

    def run(batches):
        for batch in in_slices(batches, rows):
            yield pa.RecordBatch.from_pydict(make(batch), schema=schema)

    return run


def numbered(values: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return np.arange(len(values)) - np.repeat(starts, np.diff(np.r_[starts, len(values)]))


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges start .. start+count: the range's number and the member, for each member."""
    owner = np.repeat(np.arange(len(starts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member reachable for each of ``n`` nodes over the links a-b, starting from ``label``."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def components(links: DataFrame, stages: Stages, rounds: int = 50) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps, each a grouped minimum that
    combines before the shuffle and a join back that adaptive execution can
    split where a node has very many links. Every round is written to the
    shared folder. Nodes without links are not in the result.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stages(edges)
    for _ in range(rounds):
        # large star: every larger neighbour of a node moves to the least of its neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: every smaller neighbour moves to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.*").filter("a <> b").distinct()
        )
        after = stages(small)
        # a forest of stars: no node is both a member and a centre, and no member has two centres
        state = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        centres = after.select(F.col("b").alias("a")).distinct()
        flat = state <= 1 and after.join(centres, "a", "left_semi").limit(1).count() == 0
        stages.drop(edges)
        edges = after
        if flat:
            break
    else:
        raise RuntimeError("components did not settle")
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)


def block_pairs(keyed: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """Blocks in which the members of a key meet: rows (block columns, member, left, right).

    A key of up to ``size`` members is one block. A larger one is cut into
    shards, and every pair of shards is a block, so no task holds a key and
    no pair of members is emitted. Keys of one member have no block.
    ``keyed`` mostly comes from an explode, by which Spark does not multiply
    its size, so neither side of the join may be broadcast by that size.
    """
    sizes = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    rows = keyed.join(sizes.hint("merge"), key)
    rows = rows.withColumn("__shards", F.ceil(F.col("__n") / size).cast("int"))
    rows = rows.withColumn("__own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("__shards")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("__shards") - 1),
        lambda other: F.struct(F.least(other, F.col("__own")).alias("i"), F.greatest(other, F.col("__own")).alias("j")),
    )
    return rows.withColumn("__pair", F.explode(pairs)).select(
        *keyed.columns,
        F.xxhash64(F.col(key), F.col("__pair.i"), F.col("__pair.j")).alias("block"),
        F.col("__pair.i").alias("block_i"), F.col("__pair.j").alias("block_j"),
        (F.col("__own") == F.col("__pair.i")).alias("left"),
        (F.col("__own") == F.col("__pair.j")).alias("right"),
    )
