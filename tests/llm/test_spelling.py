import random
import re
import zlib
from collections import Counter

from corpus import odd_docs, odd_rows

from logwarden.llm.spelling import Variants, gram_ranks, occurrences, prefix_and_pivots, spelling_variants, with_planted_errors

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart_by_one(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying all places."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, planted=True, p=Variants()):
    n = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if planted and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= p.least_chars and k >= p.least_count}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and apart_by_one(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= p.factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def misspelt(seed, words=60, texts=120):
    """Texts of a few letters, so that many words are near each other, with chains of ever rarer forms."""
    rng = random.Random(seed)
    letters = "abcdeéÀ×"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(words)]
    for w in list(vocabulary):
        for _ in range(3):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
            vocabulary.append(w)
    weights = [6.0 ** -(i // words if i < words else 1 + (i - words) % 3) for i in range(len(vocabulary))]
    return [(d, " ".join(w.title() if rng.random() < 0.1 else w for w in rng.choices(vocabulary, weights, k=200))) for d in range(texts)]


def test_equals_all_pairs(spark):
    rows = misspelt(3)
    expected = brute(rows)
    assert len(expected) > 100 and sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] and r[1] for r in expected)
    assert got(spelling_variants(with_planted_errors(occurrences(odd_docs(spark, rows))))) == expected


def test_without_planted_errors(spark):
    rows = misspelt(4, 30, 40)
    assert got(spelling_variants(occurrences(odd_docs(spark, rows)))) == brute(rows, planted=False)


def test_odd_rows(spark):
    rows = odd_rows() + [(20 + i, "Straße ÉCOLE école Überfluß überfluß Überflüß") for i in range(6)]
    assert got(spelling_variants(with_planted_errors(occurrences(odd_docs(spark, rows))))) == brute(rows)


def test_query_equals_all_pairs_on_documents(spark):
    from logwarden.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_spelling_variants"](spark, d)) == brute(rows)


def test_empty_table_and_no_long_words(spark):
    for rows in ([], [(1, "a few short ones"), (2, None), (None, "")]):
        assert spelling_variants(with_planted_errors(occurrences(odd_docs(spark, rows)))).collect() == []


def test_pivots_are_disjoint_and_of_least_rank(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(6, 12))) for _ in range(200)]
    ranks = gram_ranks(spark.createDataFrame([(w,) for w in words], "word string"))
    for w in words:
        last, prefix, pivots = prefix_and_pivots(w, ranks)
        cost = {i: ranks[w[i : i + 2]] for i in range(len(w) - 1)}
        assert prefix == [i for i in cost if cost[i] <= last] and len(prefix) >= 3
        assert pivots[1] - pivots[0] >= 2
        assert sum(cost[i] for i in pivots) == min(cost[i] + cost[j] for i in prefix for j in prefix if j - i >= 2)
