"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame functions only (operator 7)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import floor, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.common import SPACE, small_or_shuffled
from logwarden.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """``buckets`` bounds both multinomials; all rows labelled 1 are the trusted target.  A text passes if the mean
    log ratio of its words and word pairs is at least ``least_ratio`` and at most ``spread``
    standard deviations below the mean of trusted texts that were not counted.  That bound is averaged with
    ``least_ratio``, which weighs as much as ``prior`` such texts; ``window`` and the other numbers belong to the base rules."""

    buckets: int = 1 << 16
    least_ratio: float = -0.3
    spread: float = 4.0
    prior: int = 10
    window: int = 8
    least_words: int = 20
    repeat_percent: int = 30

    #: Ratios are whole thousandths, so that sums don't depend on their order.
    UNIT = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE + "+"), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_bucket(hashes: Column, i: Column, p: Rules) -> Column:
    return F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(p.buckets))


def upto(n: Column) -> Column:
    """0, 1, .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(text: Column, p: Rules) -> Column:
    """Buckets of all words and all pairs of words in a row."""
    return let(word_hashes(words_of(text)), lambda h: F.concat(
        F.transform(h, lambda x: F.pmod(x, F.lit(p.buckets))),
        F.transform(upto(F.size(h) - 1), lambda i: pair_bucket(h, i, p))))


def repeated_words(hashes: Column, p: Rules) -> Column:
    """Words that lie in a window of ``window`` words found twice or more."""
    w = p.window
    windows = F.transform(upto(F.size(hashes) - (w - 1)), lambda i: F.xxhash64(F.slice(hashes, i + 1, w)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(ordered, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(
            x["i"].alias("i"), ((F.get(s, i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])))
        zero = F.struct(F.lit(-w).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(w))).alias("n")), lambda a: a["n"])

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def measures(text: Column, weights: Column, p: Rules) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio_sum and n_grams of a whole text."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = F.length(plain) - F.length(F.regexp_replace(plain, SYMBOLS, ""))

    def ratio(h: Column, table: Column) -> Column:
        one = lambda b: F.element_at(table, b.cast("int") + 1)
        pair = lambda i: F.when(i + 1 < F.size(h), one(pair_bucket(h, i, p))).otherwise(0)
        return F.aggregate(upto(F.size(h)), F.lit(0).cast("long"), lambda a, i: a + one(F.pmod(F.get(h, i), F.lit(p.buckets))) + pair(i))

    return let(weights, lambda table: let(words_of(text), lambda w: let(word_hashes(w), lambda h: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(h, p).cast("long").alias("n_repeat_words"), ratio(h, table).alias("ratio_sum"),
        F.greatest(2 * F.size(w) - 1, F.lit(0)).cast("long").alias("n_grams")))))


def measured(docs: DataFrame, weights: Column, p: Rules, text: str, into: str) -> DataFrame:
    """``docs`` with :func:`measures` as the column ``into``.

    The condition always holds; as it counts rows, Spark neither pushes filters on the measures below a join nor computes them
    again for each filter.
    """
    held = docs.withColumn("__table", weights)
    return held.withColumn(into, F.when(F.monotonically_increasing_id() >= 0, measures(F.col(text), F.col("__table"), p))).drop("__table")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(__trusted, __counted): ids of the target, and whether they are in the half that is counted to judge the other."""
    return (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__trusted")).distinct()
            .withColumn("__counted", F.pmod(F.xxhash64("__trusted", F.lit("half")), F.lit(2)) == 0))


def log_ratios(docs: DataFrame, trusted: DataFrame, p: Rules, text: str, key: str) -> tuple[Column, Column]:
    """Arrays with the log ratio of target and raw corpus in each bucket, in thousandths: of the whole target, and of its counted half.

    The raw counts cover every word of every text.  Counts and ratios stay in Spark: the arrays are a written
    table of one row, read as scalar subqueries, so that plans hold no table.
    """
    seen = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text")).join(trusted, F.col("__id") == F.col("__trusted"), "left")
    counts = cut_lineage(
        seen.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.coalesce("__counted", F.lit(False)).cast("long").alias("u"),
                    F.explode(grams(F.col("__text"), p)).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"), F.sum("u").alias("half")), "rules-counts")
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw", "target", "half")]).first()

    def ratio(of: str) -> Column:
        # Counts of the half are raised to the size of the whole, so that unseen texts score alike in both.
        times = sums.target / max(1, sums[of])
        # The target's shares lean towards the raw ones with the weight of one word per bucket.
        likely = F.coalesce(F.col(of) * times * sums.raw / F.col("raw"), F.lit(0.0)) + p.buckets
        return F.rint(p.UNIT * F.log(likely / (sums.target + p.buckets))).cast("int")

    every = docs.sparkSession.range(p.buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    # One row of ``buckets`` numbers, whatever the corpus.
    row = every.agg(F.array_sort(F.collect_list(F.struct("bucket", ratio("target").alias("target"), ratio("half").alias("half")))).alias("t"))
    arrays = cut_lineage(row.select(F.col("t.target").alias("target"), F.col("t.half").alias("half")), "rules-ratios")
    return arrays.select("target").scalar(), arrays.select("half").scalar()


def base_failed(x: Column, p: Rules) -> Column:
    return (x["n_words"] < p.least_words) | (100 * x["n_repeat_words"] > p.repeat_percent * x["n_words"])


def least_ratio(docs: DataFrame, trusted: DataFrame, half: Column, p: Rules, text: str, key: str) -> int:
    """The least mean log ratio, in thousandths.

    The more text a bucket mixes, the nearer all ratios are to 0, so the bound follows the scores of trusted
    texts.  These are judged by the counts of the others, as texts of the corpus at large are; sums are in whole numbers.
    """
    held = small_or_shuffled(trusted.where("not __counted"))
    seen = measured(docs.join(held, F.col(key).cast("long") == F.col("__trusted"), "left_semi").select(text), half, p, text, "__m")
    x = F.col("__m")
    score = F.round(x["ratio_sum"] * 1000 / x["n_grams"]).cast("long")
    of = seen.where(~base_failed(x, p)).select(score.alias("s")).agg(F.count("s").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("ss")).first()
    fixed = round(p.UNIT * p.least_ratio)
    n, s, ss = of.n, of.s or 0, of.ss or 0
    bound = (s - p.spread * sqrt(max(0, n * ss - s * s))) / max(1, n) / 1000
    return floor((n * max(fixed, bound) + p.prior * fixed) / max(1, n + p.prior))


def quality_rules(docs: DataFrame, labels: DataFrame, p: Rules = Rules(), text: str = "text", key: str = "doc_id", into: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``into``: the measures, base_failed, kept and mean_ratio.

    A text fails the base rules if it has too few words or too many in repeated windows,
    and the method if its mean log ratio is below the bound of ``least_ratio()``; the comparison is in whole numbers.
    Null, empty and blank texts have no words and fail.  Without trusted labels every ratio is 0
    and the base rules decide alone.  Rows are judged one by one: repeats share a verdict, none is dropped,
    other columns are untouched.
    """
    trusted = cut_lineage(trusted_ids(labels), "rules-trusted")
    weights, half = log_ratios(docs, small_or_shuffled(trusted), p, text, key)
    least = least_ratio(docs, trusted, half, p, text, key)
    m = measured(docs, weights, p, text, "__m")
    x = F.col("__m")
    failed = base_failed(x, p)
    fine = x["ratio_sum"] >= least * x["n_grams"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return m.withColumn(into, F.struct(*[x[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & fine).alias("kept"),
                                       F.when(x["n_grams"] > 0, F.round(x["ratio_sum"] / x["n_grams"] / p.UNIT, 6)).alias("mean_ratio"))).drop("__m")


def keep_good(docs: DataFrame, labels: DataFrame, p: Rules = Rules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return quality_rules(docs, labels, p, text, key, "__rules").where("__rules.kept").drop("__rules")
