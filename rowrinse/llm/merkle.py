"""A Merkle manifest of a table, with an inclusion proof for every row by pointer jumping.

Rows are the leaves of one tree per group; the groups' roots are the leaves of
one more tree. Every node above the leaves holds a pointer to an ancestor and
the siblings passed on the way there. Joining the nodes with themselves on
that pointer doubles the distance and concatenates the two ways, so a tree of
``d`` levels takes log2(d) rounds. A leaf then takes over its parent's way.

Everything is built-in functions. Numbering goes by range-sorted tasks, so no
task holds a group, and an ancestor that very many nodes point to is copied
for every ``FAN`` of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowrinse.llm.common import Stages, partitions, quoted

ARITY = 8
# Nodes that one copy of an ancestor serves in a round of jumps.
FAN = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ("tree", "level", "place")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WAY = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 in 32 bytes of the parts in a row."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def joined(digests: Column) -> Column:
    """Digests as one hexadecimal text, empty for none."""
    return F.array_join(F.transform(digests, hexed), "")


def numbered(rows: DataFrame, group: str, order: list[str], stages: Stages) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place``, from 0 in each group by ``order``; and (group, n).

    The rows are range-sorted and written with their number in the task; the
    rows of a group in earlier tasks come before. No task holds a group.
    """
    n = partitions(rows.sparkSession, 1, 1)
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    sorted_rows = stages(
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    sorted_rows = sorted_rows.withColumn("__task", F.shiftright("__at", 33))
    runs = sorted_rows.groupBy(F.col("__task").alias("__t"), F.col(group).alias("__g")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(W.partitionBy("__g").orderBy("__t").rowsBetween(W.unboundedPreceding, -1))
    runs = stages(runs.withColumn("__shift", F.coalesce(before, F.lit(0)) - F.col("__first")))
    placed = sorted_rows.join(runs, (F.col("__task") == F.col("__t")) & F.col(group).eqNullSafe(F.col("__g")))
    sizes = runs.groupBy(F.col("__g").alias(group)).agg(F.sum("__n").alias("n"))
    return placed.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__task", "__t", "__g", "__n", "__first", "__shift"), sizes


def grown(nodes: DataFrame, height: int, stages: Stages) -> list[DataFrame]:
    """The levels of trees from their leaves (tree, place, digest), as runs (tree, place, digest, children).

    A level has one row per run of ``ARITY`` nodes and leaves out the trees that are down to one node.
    """
    levels, more = [], nodes
    for _ in range(height):
        run = more.groupBy("tree", F.floor(F.col("place") / ARITY).cast("long").alias("place")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "digest")))["digest"].alias("children"), F.max("n").alias("n"))
        run = run.withColumn("digest", digest(joined(F.col("children"))))
        levels.append(stages(run))
        # a tree goes on while it has several nodes
        left = F.ceil(F.col("n") / ARITY).cast("long")
        more = levels[-1].select("tree", "place", "digest", left.alias("n")).filter("n > 1")
    return levels


def height_of(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def step(children: Column, at: Column) -> Column:
    """The way of one level: the siblings before and after the child number ``at``, as raw bytes."""
    size = F.size(children)
    before = F.slice(children, F.lit(1), at)
    after = F.slice(children, at + 2, F.greatest(size - at - 1, F.lit(0)))
    empty = F.unhex(F.lit(""))
    raw = lambda some: F.aggregate(some, empty, lambda acc, x: F.concat(acc, x))
    return F.struct(raw(before).alias("left"), raw(after).alias("right"))


def parents(levels: list[DataFrame], base: int) -> DataFrame:
    """Rows (node, pointer to the parent, way) of the nodes that ``levels`` have as children; leaves are at ``base``."""
    out = None
    for k, level in enumerate(levels):
        rows = level.select("tree", F.col("place").alias("up"), "children", F.posexplode("children").alias("at", "digest")).select(
            "tree", F.lit(base + k).alias("level"), (F.col("up") * ARITY + F.col("at")).alias("place"),
            F.col("tree").alias("to_tree"), F.lit(base + k + 1).alias("to_level"), F.col("up").alias("to_place"),
            F.array(step(F.col("children"), F.col("at"))).alias("way"))
        out = rows if out is None else out.unionByName(rows)
    return out


def jumped(nodes: DataFrame, longest: int, stages: Stages, fan: int = FAN) -> DataFrame:
    """Nodes with their whole ways to the root, by joins that double the distance of each pointer.

    At distance ``d`` a node has up to ``ARITY ** d`` nodes that point to it,
    and there are that many times fewer such nodes; so each is copied once
    for every ``fan`` of those that point to it, and the copies stay few.
    """
    distance = 1
    while distance < longest:
        copies = max(1, math.ceil(ARITY**distance / fan))
        targets = nodes.filter(F.col("level") >= distance).select(
            *[F.col(c).alias(f"t_{c}") for c in NODE], *[F.col(f"to_{c}").alias(f"n_{c}") for c in NODE],
            F.col("way").alias("more"), F.col("subroot").alias("sub"),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        arrived = nodes.filter("to_tree is null")
        asked = nodes.filter("to_tree is not null").withColumn("copy", F.pmod(F.xxhash64(*NODE), F.lit(copies)).cast("int"))
        same = [F.col(f"to_{c}") == F.col(f"t_{c}") for c in NODE] + [asked["copy"] == targets["copy"]]
        # one that finds nothing points to the root
        moved = asked.join(targets, same, "left").select(
            *NODE, *[F.col(f"n_{c}").alias(f"to_{c}") for c in NODE],
            F.concat("way", F.coalesce("more", F.array().cast(WAY))).alias("way"), F.coalesce("subroot", "sub").alias("subroot"))
        nodes = stages(arrived.unionByName(moved))
        distance *= 2
    return nodes


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the siblings of a way make, as 32 bytes."""
    return F.aggregate(way, leaf, lambda acc, w: digest(hexed(w["left"]), hexed(acc), hexed(w["right"])))


def proofs(leaves: DataFrame, stages: Stages, group: str = "group", order: tuple[str, ...] = ("key",)) -> tuple[DataFrame, str | None]:
    """For rows (group, order..., leaf, ...): adds subroot and way; and the root in hexadecimal.

    ``leaf`` is 32 bytes. Leaves ascend by ``order``, null first, and rows that tie by their digest.
    """
    rest = [c for c in leaves.columns if c != group]
    placed, sizes = numbered(leaves, group, [*order, "leaf"], stages)
    # the groups in order are the leaves of one more tree
    trees = stages(numbered(sizes.withColumn("all", F.lit(0)), "all", [group], stages)[0].select(group, F.col("place").alias("tree"), "n"))
    count, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not count:
        return placed.drop("place").withColumns({"subroot": F.col("leaf"), "way": F.array().cast(WAY)}), None
    low, high = height_of(largest), height_of(count)

    own = placed.withColumnRenamed(group, "__group").join(trees, F.col("__group").eqNullSafe(F.col(group))).drop("__group")
    # a run of leaves is one row from here to the end; a tree of one leaf has no level above it
    runs = own.groupBy("tree", F.floor(F.col("place") / ARITY).cast("long").alias("place")).agg(
        F.array_sort(F.collect_list(F.struct("place", *[F.col(c) for c in rest]))).alias("rows"), F.max("n").alias("n"), F.first(group).alias(group))
    runs = runs.withColumn("children", F.col("rows.leaf")).withColumn(
        "digest", F.when(F.col("n") > 1, digest(joined(F.col("children")))).otherwise(F.col("children")[0]))
    runs = stages(runs.withColumn("level", (F.col("n") > 1).cast("int")))

    level_one = runs.select("tree", "place", "digest", F.ceil(F.col("n") / ARITY).cast("long").alias("n"))
    levels = grown(level_one.filter("n > 1"), max(low - 1, 0), stages)
    tops = runs.filter(F.col("n") <= ARITY).select("tree", "level", "digest")
    for k, level in enumerate(levels):
        tops = tops.unionByName(level.filter(F.col("n") <= ARITY).select("tree", F.lit(k + 2).alias("level"), "digest"))
    tops = stages(tops)
    # the upper tree: its leaves are the tops, its levels come after those of the largest tree
    upper = grown(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(count).alias("n")), high, stages)
    root = (upper[-1] if upper else tops).select(hexed(F.col("digest"))).first()[0]

    no_way = F.array().cast(WAY)
    inner = tops.select(
        "tree", "level", F.lit(0).cast("long").alias("place"), F.lit(-1).cast("long").alias("to_tree"), F.lit(low + 1).alias("to_level"),
        F.floor(F.col("tree") / ARITY).cast("long").alias("to_place"), no_way.alias("way"), F.col("digest").alias("subroot"))
    if upper:
        above = upper[0].select(F.col("place").alias("up"), F.col("children").alias("beside"))
        inner = inner.join(above, F.col("to_place") == F.col("up")).withColumn(
            "way", F.array(step(F.col("beside"), F.pmod(F.col("tree"), F.lit(ARITY)).cast("int")))).drop("up", "beside")
    else:
        inner = inner.withColumns({f"to_{c}": F.lit(None).cast(t) for c, t in zip(NODE, ("long", "int", "long"))})
    below = parents(levels, 1)
    if below is not None:
        inner = inner.unionByName(below.withColumn("subroot", F.lit(None).cast("binary")))
    beyond = parents(upper[1:], low + 1)
    if beyond is not None:
        inner = inner.unionByName(beyond.withColumn("subroot", F.lit(None).cast("binary")))
    nodes = jumped(stages(inner), low + high, stages)

    ways = nodes.select(*[F.col(c).alias(f"t_{c}") for c in NODE], F.col("way").alias("above"), "subroot")
    done = runs.join(ways, [F.col(c) == F.col(f"t_{c}") for c in NODE]).select(
        group, "subroot", "above", "children", "level", F.posexplode("rows").alias("at", "row"))
    first = F.when(F.col("level") == 1, F.array(step(F.col("children"), F.col("at")))).otherwise(no_way)
    return done.select(group, *[F.col(f"row.{c}").alias(c) for c in rest], "subroot", F.concat(first, F.col("above")).alias("way")), root


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = FIELDS,
    tampered_every: int = 3,
) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified, proof) of every row of ``docs``.

    ``proof`` has, level by level, the siblings before and after the node, raw.
    To show that proofs find changes, the rows whose checksum of the id
    ``tampered_every`` divides are folded from a leaf whose text has A-Z in
    lower case; a text without them stays the same and is verified.

    Null values are dashes in a leaf; a null group is a tree of its own, the
    first, and so is a null id in its tree. Rows that repeat an id follow one
    another by their digest. A single row is its own root with an empty proof.
    An empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession)
    lower = F.translate(quoted(text_col).cast("string"), UPPER, LOWER)
    value = {c: field(quoted(c)) for c in fields}
    changed = {**value, text_col: field(lower)}
    hit = F.coalesce(F.crc32(quoted(id_col).cast("string")) % tampered_every == 0, F.lit(False))
    leaves = docs.select(
        quoted(group_col).cast("string").alias("group"), quoted(id_col).cast("bigint").alias("key"),
        digest(*[value[c] for c in fields]).alias("leaf"),
        F.when(hit, digest(*[changed[c] for c in fields])).alias("changed"))
    found, root = proofs(leaves, stages)
    way = F.col("way")
    proof = F.concat(F.array_join(F.transform(way, lambda w: F.concat(hexed(w["left"]), hexed(w["right"]))), ""))
    return found.select(
        F.col("key").alias("id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"), hexed(folded(F.coalesce("changed", "leaf"), way)).alias("folded_root"), way.alias("proof"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
