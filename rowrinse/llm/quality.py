"""Quality rules as weak supervision: rules vote, EM weighs them, a posterior decides.

A rule names one defect and a bad document seldom has several, so there is a
class of bad documents for each rule and one of good documents. Votes are
independent within a class.

Everything on rows is built-in functions. The EM itself runs on the counts of
the vote patterns, of which there are at most 3 to the number of rules.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowrinse.llm.common import SPACE, WORD, Stages, quoted, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
GOOD, BAD, ABSTAIN = 1, -1, 0
RULES = ("length", "word_length", "symbols", "shouting", "dup_lines", "repeats", "letters")
# How a rule votes on a document with the defect it names, and the most good documents it may be wrong about.
# Within these bounds what the rules say is estimated; without them a common defect would become the rule of a good class.
SEEN = {BAD: 0.998, ABSTAIN: 0.001, GOOD: 0.001}
MISTAKEN = 0.01
# A document goes when its posterior of being good is below this.
KEEP_FROM = 0.5


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_hash, counts...) of the whole texts; a null text has no words."""
    text = F.col("__text")
    df = docs.select(quoted(id_col).alias("id"), text_of(docs, text_col).alias("__text"))
    df = df.withColumn("__w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    w = F.col("__w")
    last = F.size(w) - F.lit(WINDOW)
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    df = df.select(
        "id",
        F.xxhash64(text).alias("text_hash"),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    h = F.col("__h")
    # sorted with their places only where some window repeats at all
    placed = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("__s", placed).drop("__h")
    s = F.col("__s")
    places = F.filter(
        F.transform(
            s,
            lambda v, k: F.when(
                F.coalesce(F.get(s, k - 1)["h"] == v["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == v["h"], F.lit(False)),
                v["i"],
            ),
        ),
        lambda p: p.isNotNull(),
    )
    covered = F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("__s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote from the counts: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    mean = F.col("word_chars") / n
    return {
        "length": vote(F.col("n_words") < 10, F.col("n_words") >= 50),
        "word_length": vote((mean < 2.5) | (mean > 12), mean.between(3.5, 9)),
        "symbols": vote(20 * F.col("n_symbols") > n, 100 * F.col("n_symbols") < n),
        "shouting": vote(3 * F.col("n_capitals") > F.col("n_letters"), 5 * F.col("n_capitals") < F.col("n_letters")),
        "dup_lines": vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3)),
        "repeats": vote(10 * F.col("n_repeat_words") > n, (F.col("n_repeat_words") == 0) & (n >= 50)),
        "letters": vote(2 * F.col("n_letters") < F.col("word_chars"), 10 * F.col("n_letters") > 8 * F.col("word_chars")),
    }


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[tuple[float, list[dict[int, float]]]]]:
    """EM over vote patterns and their counts: one class of good documents, and per rule one with its defect.

    Starts from the strict reading, by which a document belongs to the classes
    of the rules that vote bad. The class of a rule stays tied to its votes by
    ``SEEN``, and a rule is wrong about ``MISTAKEN`` of the good documents at
    most; all other chances are estimated, with one document more for each vote. Returns the log prior of good and, for each rule's
    class, its log prior odds to good and, per rule and vote, the log
    likelihood ratio to good.
    """
    total = sum(patterns.values())
    flat = {v: 0.0 for v in (GOOD, ABSTAIN, BAD)}
    n = len(RULES)
    if not total:
        return 0.0, [(0.0, [dict(flat) for _ in RULES]) for _ in RULES]
    share = {}
    for p in patterns:
        bad = [r for r in range(n) if p[r] == BAD]
        good = 0.1 if bad else 0.9
        rest = bad or range(n)
        share[p] = [good, *((1 - good) / len(rest) if r in rest else 0.0 for r in range(n))]
    prior, chance = [], []
    for _ in range(rounds):
        mass = [sum(share[p][c] * k for p, k in patterns.items()) for c in range(n + 1)]
        prior = [math.log((m + 1) / (total + n + 1)) for m in mass]
        chance = []
        for c in range(n + 1):
            counts = [{v: 1.0 for v in flat} for _ in RULES]
            for p, k in patterns.items():
                weight = share[p][c] * k
                for r in range(n):
                    counts[r][p[r]] += weight
            chance.append([
                {v: math.log(SEEN[v] if c == r + 1 else x / sum(seen.values())) for v, x in seen.items()} for r, seen in enumerate(counts)])
        for ratios in chance[0]:
            ratios[BAD] = min(ratios[BAD], math.log(MISTAKEN))
        moved = 0.0
        for p in patterns:
            x = [prior[c] + sum(chance[c][r][p[r]] for r in range(n)) for c in range(n + 1)]
            top = max(x)
            e = [math.exp(v - top) for v in x]
            after = [v / sum(e) for v in e]
            moved = max(moved, abs(after[0] - share[p][0]))
            share[p] = after
        if moved < 1e-9:
            break
    return prior[0], [
        (prior[c] - prior[0], [{v: chance[c][r][v] - chance[0][r][v] for v in flat} for r in range(n)]) for c in range(1, n + 1)]


def posterior(weights: list[tuple[float, list[dict[int, float]]]], votes_of: list[Column]) -> Column:
    """The chance of the good class given the votes."""

    def odds(start: float, ratios: list[dict[int, float]]) -> Column:
        parts = [
            F.when(v == GOOD, F.lit(w[GOOD])).when(v == BAD, F.lit(w[BAD])).otherwise(F.lit(w[ABSTAIN])) for v, w in zip(votes_of, ratios)]
        return F.exp(F.least(functools.reduce(operator.add, parts, F.lit(start)), F.lit(500.0)))

    return F.lit(1.0) / functools.reduce(operator.add, [odds(*w) for w in weights], F.lit(1.0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM):
    """Rows (id, text_hash, counts, base_failed, p_good, kept), and the stages they are read from.

    A null or empty text has no words, fails the base rules and goes. Repeated
    rows are judged alike, and so are documents that tie in their votes. Texts
    are judged whole, however long. An empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession)
    counted = features(docs, id_col, text_col)
    cast = votes()
    found = stages(counted.select("*", *[cast[r].cast("int").alias(f"vote_{r}") for r in RULES]))
    names = [f"vote_{r}" for r in RULES]
    patterns = {tuple(r[:-1]): r[-1] for r in found.groupBy(*names).count().collect()}  # at most 3^7 rows
    _, weights = fit(patterns)
    p = posterior(weights, [F.col(c) for c in names])
    return found.withColumn("base_failed", base_failed()).withColumn("p_good", p).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that the base rules or the posterior reject."""
    kept = judge(docs, id_col, text_col, **options).filter("kept").select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(
        kept,
        quoted(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_of(docs, text_col)) == F.col("__hash")),
        "left_semi",
    )
