"""Mixing sources to target weights along a curriculum, in built-in functions only.

Each source's weight changes over training time t in 0..1. Its integral says
how many words of the source are due by t; inverting it at the words that a
document's predecessors take gives the document's place in training.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowrinse.llm.common import WORD, Stages, quoted, text_of

WEIGHTS = (5, 2, 1)
# (t, relative weight) knots of each weight class: heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
MOST_PASSES = 3
BUCKET_ROWS = 1024


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Per source: source_size, class, target. Windows run over sources, never over documents.

    A target is weight times one common rate, or the cap where that is more;
    ordered by cap over weight, the capped sources come first, so running
    sums give the rate.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("class", (place % len(weights)).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("class") + 1))
    per = per.withColumn("cap", MOST_PASSES * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    per = per.withColumns({
        "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    per = per.withColumn("rate", F.col("rest").cast("double") / F.col("open"))
    fits = F.col("cap") >= F.col("weight") * F.col("rate")
    rate = F.first(F.when(fits, F.col("rate")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(rate, F.lit(0.0))))
    return per.select("source", "source_size", "n_docs", "class", "target")


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integral of a piecewise linear weight has reached ``share`` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, None
    for i, ((t, w), (t2, w2)) in enumerate(zip(knots, knots[1:])):
        due = share * F.lit(whole) - F.lit(done)
        slope = (w2 - w) / (t2 - t)
        if slope:
            at = F.lit(t) + (F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * due, F.lit(0.0))) - F.lit(w)) / F.lit(slope)
        else:
            at = F.lit(t) + due / F.lit(w)
        done += areas[i]
        here = F.when(share * F.lit(whole) <= F.lit(done), at)
        out = here if out is None else F.coalesce(out, here)
    return F.coalesce(out, F.lit(knots[-1][0]))


def plan(sized: DataFrame, stages: Stages, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """For rows (id, source, size, ...): adds source_size, target, full, part, start, position.

    A document is read ``full`` times whole and once more for its first
    ``part`` words. Inside a source, documents follow one another by the MD5
    of their id; ``start`` is the number of words before. The running sum has
    two levels: sums of ranges of the hash, then of the rows in a range, so a
    source of any size is spread over many tasks. Rows that agree in id and
    size are interchangeable, or follow one another by ``__tie`` where they have it.
    """
    goal = stages(targets(sized, weights))
    rows = sized.withColumn("__md5", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumnRenamed("source", "__source").join(goal, F.col("__source").eqNullSafe(F.col("source"))).drop("__source")
    prefix = F.conv(F.substring("__md5", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    rows = rows.withColumn("__range", F.floor(prefix * ranges / F.lit(1 << 32)).cast("long"))
    rows = rows.withColumn("__s", F.xxhash64(F.col("source").isNull(), "source"))
    sums = rows.groupBy("__s", "__range").agg(F.sum("size").alias("__sum"))
    upto = W.partitionBy("__s").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("__s", "__range", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__base"))
    rows = rows.join(sums, ["__s", "__range"])
    ties = [c for c in ("__tie",) if c in sized.columns]
    inside = W.partitionBy("__s", "__range").orderBy("__md5", "size", *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("__base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.floor(F.col("target") + 0.5)
    whole = F.greatest(F.col("source_size"), F.lit(1))
    rows = rows.withColumn("full", F.expr("cast(0 as bigint)") + F.floor(words / whole))
    left = words - F.col("full") * F.col("source_size")
    rows = rows.withColumn("part", F.greatest(F.least(left - F.col("start"), F.col("size")), F.lit(0)).cast("long"))
    rows = rows.withColumn("goal_words", words.cast("long"))
    return rows.drop("__md5", "__range", "__s", "__base", "n_docs")


def position(start: Column, goal_words: Column, schedules=SCHEDULES) -> Column:
    """Training time of the word ``start`` of a source's ``goal_words``."""
    share = start.cast("double") / F.greatest(goal_words, F.lit(1)).cast("double")
    out = None
    for i, knots in enumerate(schedules):
        out = (F if out is None else out).when(F.col("class") == i, invert(share, knots))
    return out


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(
        quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("source"),
        F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long").alias("size"),
    )


def mix_plan(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", **options) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, position of its first word.

    Null and empty texts have size 0 and are not taken; a null source is a
    source of its own, the last in order. A null id sorts as an empty one.
    """
    stages = Stages(docs.sparkSession)
    sized = stages(sizes(docs, id_col, source_col, text_col))
    out = plan(sized, stages, **options)
    taken = F.col("full") * F.col("size") + F.col("part")
    return out.withColumn("taken", taken).withColumn("position", F.when(taken > 0, position(F.col("start"), F.col("goal_words"))))


def reads(
    docs: DataFrame, names: dict[str, str], id_col: str, source_col: str, text_col: str, stages: Stages | None = None, **options
) -> DataFrame:
    """One row per document: its columns under the names given, the plan, and ``reads``.

    ``reads`` has a struct (pass, position, cut, text) for each time the mix
    reads the document; its last text ends with the last word taken, and
    ``cut`` says that words are missing. Documents that are not taken have an
    empty array.
    """
    rows = docs.select(*[quoted(c).alias(inner) for c, inner in names.items()])
    text = F.col(names[text_col])
    keyed = rows.select(
        "*", F.col(names[id_col]).alias("id"), F.col(names[source_col]).cast("string").alias("source"),
        F.regexp_count(text_of(rows, names[text_col]), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("__tie"))
    stages = stages or Stages(docs.sparkSession)
    out = plan(stages(keyed), stages, **options)
    passes = F.when(
        (F.col("size") > 0) & (F.col("full") + (F.col("part") > 0).cast("int") > 0),
        F.sequence(F.lit(0).cast("long"), F.col("full") - (F.col("part") == 0).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), 1, F.col("part").cast("int")), "")

    def read(at):
        cut = (at == F.col("full")) & (F.col("part") < F.col("size"))
        return F.struct(
            at.alias("pass"), position(at * F.col("source_size") + F.col("start"), F.col("goal_words")).alias("position"),
            cut.alias("cut"), F.when(cut, short).otherwise(text).alias("text"))

    return out.withColumn("reads", F.transform(passes, read))


def sequence(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """The training sequence of ``rows`` with ``reads``: a row (id, pass, position, more columns) for each read, by position."""
    each = rows.select("*", F.posexplode("reads").alias("pass", "read"))
    each = each.select("id", "pass", F.col("read.position").alias("position"), "__tie", *columns)
    return each.orderBy("position", "id", "pass", "__tie").drop("__tie")


def mix(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", chars_col="n_chars", **options) -> DataFrame:
    """The training sequence: the columns of ``docs``, a row for each time a document is read, by position.

    The one document of a source at which the words run out is cut after its
    last taken word; ``chars_col`` then follows its text.
    """
    names = docs.columns
    inner = {c: f"__c{i}" for i, c in enumerate(names)}
    columns = {c: F.col(inner[c]) for c in names}
    if chars_col in names:
        kind = docs.schema[chars_col].dataType
        columns[chars_col] = F.when(F.col("read.cut"), F.length("read.text").cast(kind)).otherwise(columns[chars_col])
    columns[text_col] = F.col("read.text")
    out = sequence(reads(docs, inner, id_col, source_col, text_col, **options), *[columns[c].alias(inner[c]) for c in names])
    return out.select(*[F.col(inner[c]).alias(c) for c in names])


def mixed_documents(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, and, from the training sequence, taken, n_reads, position, places, texts_md5.

    The sequence is the one of :func:`mix`. It is written in its order, texts
    included, and what each document has in it is counted on what was written:
    ``places`` are the numbers of its reads in the sequence, from 0, and
    ``texts_md5`` the digests of the texts read there, both by pass.
    ``position`` is that of the first read, null for a document that is not
    taken. Null and empty texts have size 0.
    """
    stages = Stages(docs.sparkSession, codec="zstd")
    names = {id_col: "__id", source_col: "__source_of", text_col: "__text"}
    rows = reads(docs, names, id_col, source_col, text_col, stages=stages, **options)
    rows = stages(rows.select(F.monotonically_increasing_id().alias("row"), "id", "size", "source_size", "target", "__tie", "reads"))
    stages.close(keep=(rows,))
    # a block is what one task has written of the sorted rows; its number and the row's in it are data then
    block, at = F.shiftright("__at", 33).alias("block"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    written = stages(sequence(rows, "row", F.col("read.text").alias("text")).withColumn("__at", F.monotonically_increasing_id()))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = written.groupBy(block).agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    read = written.select(
        "row", "pass", "position", block, at.alias("at"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.md5("text").alias("md5"))
    read = read.join(F.broadcast(blocks), "block").withColumn("place", F.col("before") + F.col("at"))
    found = read.groupBy("row").agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("pass", "position", "place", "md5"))).alias("found"))
    out = rows.select("row", "id", "size", "source_size", "target").join(found, "row", "left")
    each = F.coalesce("found", F.array().cast(found.schema["found"].dataType))
    out = stages(out.select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.size(each).alias("n_reads"),
        F.get(each, F.lit(0))["position"].alias("position"), each["place"].alias("places"), each["md5"].alias("texts_md5")))
    stages.close(keep=(out,))
    return out
