import random
import re
from collections import Counter

from corpus import WORDS, odd_docs, odd_rows, prose, sentence

from logwarden.llm.rules import Rules, keep_good, quality_rules


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = {k for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def labels(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "doc_id long, quality int, text string")


def got(df):
    return sorted(((r.doc_id, r.rules.n_words, r.rules.word_chars, r.rules.n_symbols, r.rules.n_dup_lines, r.rules.n_repeat_words, r.rules.base_failed) for r in df.collect()), key=str)


def test_measures_equal_brute_force(spark):
    rng = random.Random(1)
    rows = odd_rows()
    for i in range(20, 60):
        line = prose(rng, 1)
        rows.append((i, "\n".join([line] * rng.randint(1, 4) + [prose(rng, 2)] + ["a b c d e f g h i"] * rng.randint(0, 3)) + rng.choice(["", " # * $ | <x>\r", "\n\n"])))
    docs = odd_docs(spark, rows)
    out = quality_rules(docs, labels(spark, [(1, 1)]))
    assert out.columns == [*docs.columns, "rules"]
    assert got(out) == sorted(((d, *base(t)) for d, t in rows), key=str)


def test_ratio_parts_target_from_the_rest_and_is_the_same_for_copies(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choices(WORDS, k=120))) for i in range(60)]
    junk = [(i, " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=120))) for i in range(100, 130)]
    known = labels(spark, [(i, 1) for i in range(40)] + [(i, 0) for i in range(100, 120)] + [(None, 1), (3, 1)])
    out = {r.doc_id: r.rules for r in quality_rules(odd_docs(spark, good + junk + [(200, good[50][1])]), known, Rules(buckets=1 << 12)).collect()}
    assert all(out[i].kept for i in range(60)) and not any(out[i].kept for i in range(100, 130))
    assert out[200].mean_ratio == out[50].mean_ratio
    assert max(out[i].mean_ratio for i in range(100, 130)) < min(out[i].mean_ratio for i in range(60))


def test_ratio_is_the_mean_of_rounded_logs(spark):
    from math import log

    p = Rules(buckets=1 << 10)
    text = "one two three"
    out = quality_rules(odd_docs(spark, [(1, text), (2, "four five")]), labels(spark, [(1, 1)]), p).where("doc_id = 1").first().rules
    one = round(1000 * log((1 * 8 / 1 + p.buckets) / (5 + p.buckets)))
    assert out.mean_ratio == round(one / 1000, 6) and out.base_failed and not out.kept


def test_no_labels_and_empty_tables(spark):
    rows = [(i, sentence(random.Random(i), 40)) for i in range(5)]
    assert keep_good(odd_docs(spark, rows), labels(spark, [])).count() == 5
    assert quality_rules(odd_docs(spark, []), labels(spark, [(1, 1)])).collect() == []
    assert keep_good(odd_docs(spark, rows), labels(spark, [])).columns == odd_docs(spark, rows).columns


def test_main_path_has_no_python(spark):
    plan = quality_rules(odd_docs(spark), labels(spark, [(1, 1)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_junk_is_rejected_alike_however_large_the_corpus(spark):
    """Junk of the same words in another order and mix; fewer buckets for the same text stand in for a larger corpus."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    vocabulary = [f"{w}{i}" for w in WORDS for i in range(100)]
    share = [1 / (i + 1) ** 0.8 for i in range(len(vocabulary))]
    rejected, lost = [], []
    for n, bits in ((1000, 14), (3000, 13), (3000, 11)):
        rows = [(i, " ".join(rng.choices(vocabulary, share[::-1] if i % 10 == 0 else share, k=60))) for i in range(n)]
        known = labels(spark, [(i, int(i % 10 != 0)) for i in range(n) if i % 10 in (0, 1, 2, 3, 4)])
        out = quality_rules(odd_docs(spark, rows), known, Rules(buckets=1 << bits)).where(~F.col("rules.base_failed"))
        got = {r.doc_id: r.rules.kept for r in out.collect()}
        rejected.append(sum(not k for d, k in got.items() if d % 10 == 0) / sum(d % 10 == 0 for d in got))
        lost.append(sum(not k for d, k in got.items() if d % 10) / sum(d % 10 > 0 for d in got))
    assert min(rejected) > 0.95 and max(lost) < 0.02, (rejected, lost)


def test_plan_holds_no_table(spark):
    plan = quality_rules(odd_docs(spark), labels(spark, [(1, 1)]))._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_every_trusted_row_counts(spark):
    """Labelled rows that ``docs`` lacks change nothing, however many there are."""
    rows = [(i, sentence(random.Random(i), 40)) for i in range(30)]
    few = labels(spark, [(i, 1) for i in range(15)])
    many = spark.range(1000, 41_000).selectExpr("id as doc_id", "1 as quality", "cast(null as string) as text").unionByName(few)
    got = [sorted((r.doc_id, r.rules.mean_ratio) for r in quality_rules(odd_docs(spark, rows), k).collect()) for k in (few, many)]
    assert got[0] == got[1]
