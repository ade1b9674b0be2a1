"""SimHash near-duplicates: fingerprints, BK-trees over shards of equal bit blocks, components."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import (
    Stages, block_pairs, components, local_components, numbered, partitions, per_batch, quoted, spread, text_of,
)

BITS = 64
SHARD = 2048
QUERIES = 512
GROUP_ROWS = 40_000
# Bits: of more values than 2^21, from half of 2^8 to 2^8 share the bits of a sampled mask by chance.
KEY_TEXTS = 8
# Members of a proposed group compared at once, and how many of those that are joined go on.
GROUP_SHARD, STAND_INS = 512, 4


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def shingles_of(text: str, shingle: int) -> list[memoryview]:
    """All word shingles, A-Z in lower case, joined by single spaces; the whole sequence where it is shorter."""
    words = text.encode().lower().split()  # of bytes: A-Z and the six ASCII separators only
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
    return [joined[s:e] for s, e in zip(starts, ends[width - 1 :].tolist())]


def fingerprint(text: str, shingle: int = 4) -> int:
    """Majority bits over the XXH64 (seed 42) of all word shingles; zero for a text without words."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles_of(text, shingle)], np.uint64))


def wide_hashes(text: str, shingle: int) -> np.ndarray:
    """The distinct 128-bit hashes of the word shingles as rows of two halves, sorted by the first."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(s) for s in shingles_of(text, shingle)]), np.uint64).reshape(-1, 2)
    return both[np.unique(both[:, 0], return_index=True)[1]]


def wide_fingerprint(text: str, shingle: int) -> tuple[int, int]:
    """Two fingerprints from the halves of 128-bit hashes; a repeated shingle counts once, as in the exact comparison."""
    both = wide_hashes(text, shingle)
    return majority(np.ascontiguousarray(both[:, 0])), majority(np.ascontiguousarray(both[:, 1]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (id, fingerprint as a signed long), one per row of ``docs``."""
    key = docs.select(quoted(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def make(batch):
        found = [fingerprint(t, shingle) for t in batch["text"].to_pylist()]
        return {"id": batch["id"], "fp": np.array(found, np.uint64).view(np.int64)}

    return key.select(F.col("id").cast("bigint"), "text").mapInArrow(per_batch(make, schema), "id bigint, fp bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees, one per block: the children of a node are keyed by their distance to it.

    ``block`` is sorted. Every level is built for all trees at once: of the
    values waiting at a node at one distance, the first becomes the child
    under that key and the others wait there.
    """

    def __init__(self, block: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value, self.parent, self.edge = value, np.full(n, -1), np.zeros(n, np.int64)
        first = np.r_[True, block[1:] != block[:-1]] if n else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        self.root_block = block[self.roots]
        at = np.repeat(self.roots, np.diff(np.r_[self.roots, n])) if n else np.zeros(0, np.int64)
        waiting = np.flatnonzero(~first)
        at = at[waiting]
        while len(waiting):
            edge = distance(value[waiting], value[at])
            order = np.lexsort((waiting, edge, at))
            waiting, at, edge = waiting[order], at[order], edge[order]
            child = np.r_[True, (at[1:] != at[:-1]) | (edge[1:] != edge[:-1])]
            self.parent[waiting[child]], self.edge[waiting[child]] = at[child], edge[child]
            owner = waiting[child][np.cumsum(child) - 1]
            waiting, at = waiting[~child], owner[~child]
        keys = np.where(self.parent >= 0, self.parent * (BITS + 1) + self.edge, -1)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def within(self, query: np.ndarray, root: np.ndarray, radius: int):
        """Yields (query number, node) at most ``radius`` apart, following only edges that can lead to some."""
        who, node = np.arange(len(query)), root
        while len(who):
            d = distance(query[who], self.value[node])
            hit = d <= radius
            if hit.any():
                yield who[hit], node[hit]
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            owner, place = spread(low, high - low)
            who, node = who[owner], self.order[place]


def bit_blocks(n: int, radius: int) -> list[tuple[int, ...]]:
    """Masks of which any two values within ``radius`` agree in at least one.

    The bits are cut into ``b`` blocks; at most ``radius`` of them differ, so
    some ``b - radius`` agree. More values need longer agreement to keep
    shards short, hence more blocks.
    """
    b = radius + 1
    while BITS * (b - radius) / b < math.log2(max(n, 2)) - 6 and b < radius + 4:
        b += 1
    edges = [round(BITS * i / b) for i in range(b + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(b)]
    return [sum(masks[i] for i in chosen) for chosen in itertools.combinations(range(b), b - radius)]


def sampled_blocks(n: int) -> list[tuple[int, ...]]:
    """Masks for radii at which no mask is both sure and selective, as many for any number of values.

    Ten blocks, two at a time. More values need longer agreement to keep
    shards short: from 2^21 on the masks are as many sets of bits drawn at
    random, one bit longer for each doubling, so what is shuffled and compared
    grows with the values. The choices miss different pairs, more of them
    where they are longer, so the caller has to find those in another way.
    """
    b = 10
    edges = [round(BITS * i / b) for i in range(b + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(b)]
    pairs = [sum(some) for some in itertools.combinations(masks, 2)]
    if n < 1 << 21:
        return pairs
    drawn, width = np.random.default_rng(BITS), min(n.bit_length() - KEY_TEXTS, BITS // 2)
    return [sum(1 << int(bit) for bit in drawn.choice(BITS, width, replace=False)) for _ in pairs]


def near_links(values: DataFrame, n: int, radius: int, masks: list[int] | None = None) -> DataFrame:
    """Links (a, b) that connect the rows (node, fp, more) whose ``fp`` agree in a mask and are within ``radius``.

    The default masks miss no two values within the radius. ``more`` is null
    or a second fingerprint; both together may then differ in twice the radius.

    Within a block of a shard, the links are those from each member to the
    smallest one it is connected to: as good as all of them for components.
    """
    spark = values.sparkSession
    masks = [m - (1 << 64) if m >> 63 else m for m in masks or bit_blocks(n, radius)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    keyed = values.select(F.explode(keys).alias("key"), "node", "fp", "more")
    blocks = block_pairs(keyed, "key", "node", SHARD).select("block", "node", "fp", "more", "left", "right")
    tasks = partitions(spark, n * len(masks), GROUP_ROWS)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["block", "node"]).sort_values(["block", "node"], ignore_index=True)
        node_of, wide = rows["node"].to_numpy(), rows["more"].notna().all()
        more = rows["more"].to_numpy().astype(np.int64).view(np.uint64) if wide else None
        fp, block = rows["fp"].to_numpy().view(np.uint64), rows["block"].to_numpy()
        tree_rows = np.flatnonzero(rows["right"].to_numpy())
        forest = Forest(block[tree_rows], fp[tree_rows])
        asks = np.flatnonzero(rows["left"].to_numpy())
        place = np.searchsorted(forest.root_block, block[asks])
        asks, place = asks[place < len(forest.roots)], place[place < len(forest.roots)]
        same = forest.root_block[place] == block[asks] if len(asks) else np.zeros(0, bool)
        asks, root = asks[same], forest.roots[place[same]] if len(asks) else place
        label = np.arange(len(rows))
        for at in range(0, len(asks), QUERIES):
            part = asks[at : at + QUERIES]
            for who, node in forest.within(fp[part], root[at : at + QUERIES], radius):
                if wide:
                    a, b = part[who], tree_rows[node]
                    near = distance(fp[a], fp[b]) + distance(more[a], more[b]) <= 2 * radius
                    who, node = who[near], node[near]
                label = local_components(len(rows), part[who], tree_rows[node], label)
        moved = np.flatnonzero(label != np.arange(len(rows)))
        return pd.DataFrame({"a": node_of[moved], "b": node_of[label[moved]]})

    return (
        blocks.withColumn("task", F.pmod(F.col("block"), F.lit(tasks)).cast("int"))
        .groupBy("task").applyInPandas(search, "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """Rows (id, fp, component): documents whose fingerprints are chained by at most ``radius`` bits.

    ``component`` is the smallest id reachable. Null and empty texts have
    fingerprint zero and link as any other. A null id counts as no id: its row
    gets the component of its fingerprint, null if no id is in it. Repeated
    rows stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    marked = stages(fingerprints(docs, id_col, text_col, shingle))
    values = stages(marked.groupBy("fp").agg(F.min("id").alias("first")))
    links = stages(near_links(values.select(F.col("fp").alias("node"), "fp", F.lit(None).cast("bigint").alias("more")), values.count(), radius))
    reached = components(links, stages)
    joined = values.join(reached, values["fp"] == reached["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = stages(joined.join(least, "root").select("fp", "component"))
    stages.close(keep=(marked, named))
    return marked.join(named, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of fingerprints: the one with the smallest id."""
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.filter(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("__id")).distinct()
    return docs.join(keep, quoted(id_col).eqNullSafe(F.col("__id")), "left_semi")


def shingles(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    return np.ascontiguousarray(wide_hashes(text, shingle)[:, 0])


def least_shared(size: int, similarity: float) -> int:
    """How many shingles a set of ``size`` shares at least with any set that is similar enough."""
    return math.ceil(similarity * size * (1 - 1e-6))


def common_start(size: int, similarity: float) -> int:
    """How many of its first common shingles the start of a set must hold, see ``start_of``."""
    return min(1 + size // 10, least_shared(size, similarity))


def start_of(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a sorted set that hold its first ``common_start`` common ones with any similar set.

    At most ``size - least_shared`` hashes are not common, so the k-th common
    one is among the first ``size - least_shared + k``.
    """
    return hashes[: len(hashes) - least_shared(len(hashes), similarity) + common_start(len(hashes), similarity)]


def wanted_start(size: int, similarity: float) -> int:
    """How many hashes the starts of a set of ``size`` and of any similar set have in common at least."""
    return common_start(least_shared(size, similarity), similarity)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Parity of the hashes that fall on each of about twice as many bits; two sets differ in no fewer elements than bits."""
    width = 2 << min(max(len(hashes) - 1, 1).bit_length(), 11)
    width = max(width, BITS)
    return np.packbits(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1)


def possible_pairs(size: np.ndarray, root: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, similarity: float):
    """Yields (i, j) of a left and a right member with other roots whose sizes and parities allow the similarity."""
    width = np.array([len(b) for b in bits])
    for low in np.unique(width):
        near = np.flatnonzero(width == low)
        for high in np.unique(width[width >= low]):
            far = np.flatnonzero(width == high)
            folded = np.bitwise_xor.reduce(np.frombuffer(b"".join([bits[j] for j in far]), np.uint8).reshape(len(far), -1, low), axis=1)
            there = 1 - 2 * np.unpackbits(folded, axis=1).astype(np.float32)
            for at in range(0, len(near), QUERIES):
                part = near[at : at + QUERIES]
                here = np.frombuffer(b"".join([bits[i] for i in part]), np.uint8).reshape(len(part), -1)
                apart = (8 * low - (1 - 2 * np.unpackbits(here, axis=1).astype(np.float32)) @ there.T) / 2
                a, b = size[part][:, None], size[far][None, :]
                ok = (apart <= (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-3) & (root[part][:, None] != root[far][None, :])
                ok &= np.minimum(a, b) >= similarity * (1 - 1e-6) * np.maximum(a, b)
                ok &= (left[part][:, None] & right[far][None, :]) | (right[part][:, None] & left[far][None, :])
                i, j = np.nonzero(ok)
                yield part[i], far[j]


def missed_pairs(marked: DataFrame, roots: DataFrame, similarity: float, stages: Stages) -> DataFrame:
    """Pairs (a, b) of text hashes with other roots, among them all whose similarity is reached.

    ``marked`` has (text_hash, size, wanted, start, bits), ``roots`` (text_hash,
    root). Exact prefix filter in two steps. The starts of two similar sets, in
    the order of the hashes, have at least ``wanted`` hashes in common, so a
    text stays only if so many of its start are in starts of other groups too.
    Of these all but the ``wanted - 1`` most frequent are keys, of which two
    similar texts have one in common. Sizes and parities then rule out pairs.
    """
    spark = marked.sparkSession
    ddl = "h bigint, text_hash bigint, wanted int"
    schema = pa.schema([("h", pa.int64()), ("text_hash", pa.int64()), ("wanted", pa.int32())])

    def unfold(batch):
        starts = batch["start"].to_pylist()
        count = np.array([len(s) // 8 for s in starts], np.int64)
        return {
            "h": np.frombuffer(b"".join(starts), np.int64),
            "text_hash": np.repeat(batch["text_hash"].to_numpy(), count), "wanted": np.repeat(batch["wanted"].to_numpy(), count)}

    rows = marked.select("text_hash", "wanted", "start").mapInArrow(per_batch(unfold, schema), ddl)
    shared = stages(rows.groupBy("h").agg(F.min("text_hash").alias("x"), F.max("text_hash").alias("y")).filter("x <> y").select("h"))
    held = rows.join(shared, "h", "left_semi").groupBy("text_hash", "wanted").agg(F.collect_set("h").alias("hs"))
    held = stages(held.filter(F.size("hs") >= F.col("wanted")).join(roots, "text_hash"))
    single = held.select("text_hash", "wanted", "root", F.explode("hs").alias("h"))
    often = stages(single.groupBy("h").agg(
        F.count(F.lit(1)).alias("often"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h", "often"))
    ranked = single.join(often.hint("merge"), "h").groupBy("text_hash", "wanted", "root").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("hs"))
    ranked = ranked.filter(F.size("hs") >= F.col("wanted")).select(
        "text_hash", "root", F.slice("hs", F.lit(1), F.size("hs") - F.col("wanted") + 1)["h"].alias("hs"))
    facts = marked.select("text_hash", "size", "bits").join(ranked.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    keyed = stages(ranked.join(facts, "text_hash").select("text_hash", "root", "size", "bits", F.explode("hs").alias("h")))
    blocks = block_pairs(keyed, "h", "text_hash", SHARD).select("block", "text_hash", "root", "size", "bits", "left", "right")
    tasks = partitions(spark, keyed.count(), GROUP_ROWS)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        for _, part in rows.groupby("block"):
            if part["root"].nunique() > 1:
                ids, bits = part["text_hash"].to_numpy(), part["bits"].tolist()
                columns = [part[c].to_numpy() for c in ("size", "root", "left", "right")]
                for i, j in possible_pairs(columns[0], columns[1], bits, columns[2], columns[3], similarity):
                    found.append(np.c_[np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])])
        both = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return (
        blocks.withColumn("task", F.pmod(F.col("block"), F.lit(tasks)).cast("int"))
        .groupBy("task").applyInPandas(search, "a bigint, b bigint").distinct()
    )


def linked_groups(members: DataFrame, sets_of, similarity: float, stages: Stages) -> DataFrame:
    """Links (a, b) of similar texts inside proposed groups (group, text_hash), in work linear in a group.

    A group is cut into shards, whose members are compared with one another
    and joined. Of what is joined the members with most links then stand for
    it, and meet those of the other shards in the next round, until a group
    is one shard or a round leaves over nine tenths of it. All links are exact; what is
    still apart then is left to the prefix filter. ``sets_of`` gives the
    shingles (text_hash, shingles) of wanted texts.
    """
    spark = members.sparkSession
    links = None
    for turn in range(64):
        sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shard = F.pmod(F.xxhash64("text_hash", F.lit(turn)), F.ceil(F.col("n") / GROUP_SHARD))
        blocks = stages(members.join(sizes, "group").select("group", "text_hash", "n", F.xxhash64("group", shard).alias("block")))
        count = blocks.count()
        if not count:
            break
        tasks = partitions(spark, count, 2 * GROUP_SHARD)

        def compare(rows: pd.DataFrame) -> pd.DataFrame:
            out = [[], [], [], []]
            for _, part in rows.groupby("block"):
                part = part.drop_duplicates("text_hash").sort_values("text_hash")
                every = np.ones(len(part), bool)
                i, j = exact_links([np.frombuffer(x, np.uint64) for x in part["shingles"]], every, every, similarity)
                label = local_components(len(part), i, j)
                # the best linked of each component go on; they are no link where both ends are the same
                degree = np.bincount(i, minlength=len(part))
                order = np.lexsort((np.arange(len(part)), -degree, label))
                first = order[numbered(label[order]) < STAND_INS]
                moved = np.flatnonzero(label != np.arange(len(part)))
                ids = part["text_hash"].to_numpy()
                for column, values in zip(out, (
                    np.r_[ids[moved], ids[first]], np.r_[ids[label[moved]], ids[first]],
                    np.r_[part["group"].to_numpy()[moved], part["group"].to_numpy()[first]], np.r_[part["n"].to_numpy()[moved], part["n"].to_numpy()[first]],
                )):
                    column.append(values)
            return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(("a", "b", "group", "n"), out)})

        found = stages(
            blocks.join(sets_of(blocks.select("text_hash")), "text_hash")
            .withColumn("task", F.pmod(F.col("block"), F.lit(tasks)).cast("int"))
            .groupBy("task").applyInPandas(compare, "a bigint, b bigint, group bigint, n bigint")
        )
        new = found.filter("a <> b").select("a", "b")
        links = new if links is None else links.unionByName(new)
        standing = found.filter(F.col("a") == F.col("b")).filter(F.col("n") > GROUP_SHARD).select("group", F.col("a").alias("text_hash"), "n")
        fewer = standing.groupBy("group", "n").agg(F.count(F.lit(1)).alias("left")).filter("10 * left <= 9 * n").select("group")
        members = stages(standing.select("group", "text_hash").join(fewer, "group", "left_semi"))
    return links if links is not None else spark.createDataFrame([], "a bigint, b bigint")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 14
) -> DataFrame:
    """Rows (text_hash, component): texts chained by a Jaccard similarity of word shingles of ``similarity`` or more.

    Fingerprints of twice 64 bits within twice ``radius`` propose groups,
    through BK-trees over the first half, so that chance proposes almost none;
    inside a proposed group similarities are computed exactly, see
    :func:`linked_groups`. This joins large groups of copies cheaply but may
    miss a pair; a prefix filter that misses none then finds the pairs between
    the groups that are left.
    ``component`` is the smallest id of the chain. Equal texts are one text;
    texts without words are similar to each other.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    key = docs.select(quoted(id_col).cast("bigint").alias("id"), text_of(docs, text_col).alias("text"))
    key = key.select("id", "text", F.xxhash64("text").alias("text_hash"))
    numbers = ["id", "text_hash", "fp", "more"]
    schema = pa.schema([*[(c, pa.int64()) for c in numbers], ("size", pa.int32()), ("wanted", pa.int32()), ("start", pa.binary()), ("bits", pa.binary())])
    ddl = "id bigint, text_hash bigint, fp bigint, more bigint, size int, wanted int, start binary, bits binary"

    done: dict[int, tuple] = {}  # of one task: copies are marked once, and carry no start and bits

    def mark(batch):
        out = []
        for text_hash, text in zip(batch["text_hash"].to_pylist(), batch["text"].to_pylist()):
            if text_hash in done:
                out.append((*done[text_hash], None, None))
                continue
            both = wide_hashes(text, shingle)
            first, second = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            done[text_hash] = majority(first), majority(second), len(first), wanted_start(len(first), similarity)
            out.append((*done[text_hash], start_of(first, similarity).tobytes(), parity(first).tobytes()))
        fp, more, *rest = zip(*out)
        names = ("size", "wanted", "start", "bits")
        return {
            "id": batch["id"], "text_hash": batch["text_hash"],
            "fp": np.array(fp, np.uint64).view(np.int64), "more": np.array(more, np.uint64).view(np.int64), **dict(zip(names, rest))}

    marked = stages(key.mapInArrow(per_batch(mark, schema), ddl))
    texts = stages(marked.groupBy("text_hash", "fp", "more").agg(F.min("id").alias("first")))
    n = texts.count()
    links = stages(near_links(texts.withColumnRenamed("text_hash", "node"), n, radius, sampled_blocks(n)))
    groups = components(links, stages)
    proposed = texts.join(groups, texts["text_hash"] == groups["node"], "left").select(
        "text_hash", "first", F.coalesce("component", "text_hash").alias("group"))
    proposed = stages(proposed)
    set_schema = pa.schema([("text_hash", pa.int64()), ("shingles", pa.binary())])

    def gather(batch):
        return {"text_hash": batch["text_hash"], "shingles": [shingles(t, shingle).tobytes() for t in batch["text"].to_pylist()]}

    def sets_of(wanted: DataFrame) -> DataFrame:
        picked = key.select("text_hash", "text").join(wanted, "text_hash", "left_semi")
        return picked.mapInArrow(per_batch(gather, set_schema), "text_hash bigint, shingles binary").dropDuplicates(["text_hash"])

    exact = linked_groups(proposed.select("group", "text_hash"), sets_of, similarity, stages)
    reached = components(exact, stages)
    roots = stages(texts.join(reached, texts["text_hash"] == reached["node"], "left").select(
        "text_hash", F.coalesce("component", "text_hash").alias("root")))
    pairs = stages(missed_pairs(marked.filter("start is not null"), roots, similarity, stages))
    pair_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batch):
        ok = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= similarity * (len(x) + len(y) - both))
        return {c: batch[c].filter(pa.array(ok, pa.bool_())) for c in ("a", "b")}

    sets = stages(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct()))
    sided = pairs.join(sets.select(F.col("text_hash").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("text_hash").alias("b"), F.col("shingles").alias("y")), "b")
    late = stages(sided.select("a", "b", "x", "y").mapInArrow(per_batch(confirm, pair_schema), "a bigint, b bigint"))
    reached = components(exact.unionByName(late), stages)
    joined = proposed.join(reached, proposed["text_hash"] == reached["node"], "left").select(
        "text_hash", "first", F.coalesce("component", "text_hash").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    out = stages(joined.join(least, "root").select("text_hash", "component"))
    stages.close(keep=(out,))
    return out


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right member whose Jaccard similarity reaches ``similarity``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    value, place = np.unique(np.concatenate(sets), return_inverse=True) if len(owner) else (np.zeros(0), np.zeros(0, int))
    shared = np.zeros((len(sets), len(sets)), np.float32)
    counts = np.bincount(place, minlength=len(value))
    keep = counts[place] > 1
    owner, place = owner[keep], np.unique(place[keep], return_inverse=True)[1]
    for at in range(0, int(place.max()) + 1 if len(place) else 0, 8192):
        here = (place >= at) & (place < at + 8192)
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[here], place[here] - at] = 1
        shared += m @ m.T
    union = size[:, None] + size[None, :] - shared
    near = (shared >= similarity * union) & left[:, None] & right[None, :]
    return np.nonzero(near)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, that with the smallest id, of each chain of similar texts.

    Of rows that repeat id and text all stay; a null id stays only where its chain has no id.
    """
    found = similar_documents(docs, id_col, text_col, **options)
    names = found.select(F.col("text_hash").alias("__hash"), F.col("component").alias("__id"))
    return docs.join(
        names,
        (F.xxhash64(text_of(docs, text_col)) == F.col("__hash")) & quoted(id_col).cast("bigint").eqNullSafe(F.col("__id")),
        "left_semi",
    )
