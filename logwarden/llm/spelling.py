"""Spelling variants of words by pivotal grams (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.common import small_or_shuffled
from logwarden.session import cut_lineage


@dataclass(frozen=True)
class Variants:
    """Words of ``least_chars`` code points and ``least_count`` occurrences; a form has ``factor`` times the word's occurrences."""

    pattern: str = "[A-Za-z\\u00C0-\\u00FF]+"
    least_chars: int = 6
    least_count: int = 5
    factor: int = 5


def occurrences(docs: DataFrame, p: Variants = Variants(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, run) for every maximal run of the pattern, A-Z lowered; a null text has none.  Other columns are not read."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(key).alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(p.pattern), F.lit(0))).alias("run"))


def with_planted_errors(runs: DataFrame) -> DataFrame:
    """(run) with a code point deleted where 199 divides the hash of doc_id and run, as the query's contract says; a null doc_id counts as ''."""
    named = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return named.select(F.when(F.pmod("h", F.lit(199)) == 0, cut).otherwise(F.col("run")).alias("run"))


def word_counts(runs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counts combine before the shuffle."""
    return (runs.where(F.length("run") >= p.least_chars).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
            .where(F.col("n") >= p.least_count))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of every bigram by the words that hold it, rarest first.  The pattern has 90 letters after lowering, so at most 8,100 bigrams."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    grams = words.select("word", at.alias("at")).select(F.col("word").substr(F.col("at"), F.lit(2)).alias("gram"))
    counts = grams.groupBy("gram").count().collect()
    return {r.gram: i for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r.gram)))}


def prefix_and_pivots(word: str, ranks: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """Rank of the last gram of the word's prefix, and the places of the prefix's and of the pivots' bigrams.

    One edit changes at most two bigrams, so the prefix holds the three rarest (and any equal to the last of
    them); of three there are always two that do not overlap.  The pivots are the two disjoint ones of the prefix with the
    least sum of ranks: going along the word, the best single gram that ends before the current one is kept.
    """
    ranked = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranked)[2]
    prefix = [i for i, r in enumerate(ranked) if r <= last]
    best_pair, best_one, waiting = None, None, []
    for i in prefix:
        while waiting and waiting[0] <= i - 2:
            one = waiting.pop(0)
            best_one = one if best_one is None or ranked[one] < ranked[best_one] else best_one
        if best_one is not None and (best_pair is None or ranked[best_one] + ranked[i] < ranked[best_pair[0]] + ranked[best_pair[1]]):
            best_pair = (best_one, i)
        waiting.append(i)
    return last, prefix, list(best_pair)


def gram_rows(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Index and probe rows of the words: key, word, last, probe.

    If two words differ by one edit, of the two pivots of the one whose prefix ends rarer at least one is
    untouched, and it lies in the other's prefix.  The edit is then on one side of that gram, so from the word's start up to
    the gram, or from the gram to the word's end, both are equal.  A key is such a side with the length of the indexed word:
    it holds gram and place, and the lengths it is asked with are the position limits of one edit.
    """
    schema = "key string, word string, last int, probe boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, of, lasts, probes = [], [], [], []
            for word in batch.column(0).to_pylist():
                last, prefix, pivots = prefix_and_pivots(word, ranks)
                sides = [(i, 0, False) for i in prefix] + [(i, more, True) for i in pivots for more in (-1, 0, 1)]
                for i, more, probe in sides:
                    for side in (f"<{word[: i + 2]}", f">{word[i:]}"):
                        keys.append(f"{len(word) + more}{side}")
                        of.append(word)
                        lasts.append(last)
                        probes.append(probe)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(of, pa.string()), pa.array(lasts, pa.int32()), pa.array(probes, pa.bool_())],
                                             names=["key", "word", "last", "probe"])

    return words.select("word").mapInArrow(run, schema)


def near_words(words: DataFrame, p: Variants = Variants()) -> DataFrame:
    """(word, near) for all pairs of words that differ by exactly one inserted, deleted or replaced code point, both ways round."""
    rows = cut_lineage(gram_rows(words, gram_ranks(words)), "spelling-grams")
    index = rows.where("not probe").select("key", "word", "last")
    probe = rows.where("probe").select("key", F.col("word").alias("near"), F.col("last").alias("near_last"))
    found = probe.join(index, "key").where("near_last <= last and word != near and levenshtein(word, near, 1) = 1")
    pairs = found.select(F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near")).distinct()
    pairs = cut_lineage(pairs, "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame, p: Variants = Variants()) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form): the last form that following them leads to.

    Every step multiplies the count by ``factor`` (at least 2), so no chain is longer than 63; each round doubles
    the steps that a word has gone, so six rounds are enough, and fewer when all are at their ends.
    """
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(6):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(reached.join(small_or_shuffled(onward), "root", "left"), "spelling-roots")
        if not moved.where("next is not null").limit(1).count():
            break
        reached = moved.select("word", F.coalesce("next", "root").alias("root"))
    return reached


def spelling_variants(runs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """One row per word of ``runs`` (run): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least ``factor`` times
    the word's n, else null; ``root`` is where following forms ends, the word itself without a form.  Words are distinct
    runs of at least ``least_chars`` (three bigrams at least) code points and ``least_count`` occurrences; null and shorter runs are none.  No runs give no rows.
    """
    words = cut_lineage(word_counts(runs, p), "spelling-words")
    pairs = near_words(words, p).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.minus") >= p.factor * F.col("n")
    formed = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
                                       F.when(is_form, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where("form is not null"), p)
    return (formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
