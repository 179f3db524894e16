import hashlib
import random
import zlib

import numpy as np
from corpus import odd_docs, odd_rows
from pyspark.sql import functions as F

from logwarden.llm.periodic import Grammar, Periods, find_runs, periodic_runs, strongest, with_planted_periods


def brute_runs(w, least=24, powers=3):
    """Every period, every maximal stretch of words equal to the word a period later; the least period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def planted(d, words):
    n, h = len(words), zlib.crc32(str(d).encode())
    if d is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 23, 24, 25, 70, 300]))]
    for _ in range(rng.randint(0, 3) if len(words) > 30 else 0):
        start, q = rng.randrange(len(words)), rng.randint(1, len(words) // 4)
        for i in range(start + q, min(len(words), start + rng.randint(1, len(words)))):
            words[i] = words[i - q]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(2)
    seen = 0
    for p in (Periods(), Periods(least=6, powers=2), Periods(block=7)):
        for _ in range(60):
            texts = [periodic_words(rng) for _ in range(8)]
            for words, runs in zip(texts, find_runs([np.array(w, np.int64) for w in texts], p)):
                expected = brute_runs(words, p.least, p.powers)
                seen += len(expected)
                assert [tuple(map(int, r)) for r in runs] == expected
    assert seen > 500


def test_grammar_answers_extensions():
    rng = np.random.default_rng(3)
    for alphabet in (1, 2, 5):
        s = np.r_[alphabet, rng.integers(0, alphabet, 400), alphabet + 1]
        s[100:200] = s[40:140]
        i, j = rng.integers(1, 401, (2, 3000))
        i, j = i[i != j], j[i != j]
        forward = [next(k for k in range(500) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
        backward = [next(k for k in range(500) if s[a - 1 - k] != s[b - 1 - k]) for a, b in zip(i, j)]
        grammar = Grammar(s)
        assert grammar.extend(i, j).tolist() == forward
        assert grammar.extend(i, j, forward=False).tolist() == backward


def test_long_text_needs_few_levels():
    words = np.r_[0, np.tile(np.arange(1, 8), 30_000), 9]
    assert len(Grammar(words).levels) < 100
    assert find_runs([words[1:-1]])[0].tolist() == [[0, 210_000, 7]]


def test_operator_and_odd_rows(spark):
    rng = random.Random(4)
    rows = odd_rows() + [(100 + i, rng.choice([" ", "\n", "\x0b\t"]).join(f"é{w} x" for w in periodic_words(rng))) for i in range(60)]
    out = periodic_runs(odd_docs(spark, rows))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    expected = []
    for d, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute_runs(words) if len(words) < 1000 else []  # the long texts of odd_rows are random
        expected.append((d, len(words), runs, " ".join(collapsed(words, runs))))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(r[2] for r in expected)


def test_empty_table(spark):
    assert periodic_runs(odd_docs(spark, [])).collect() == []


def test_strongest_breaks_ties_exactly(spark):
    kind = "runs array<struct<start:long,length:long,period:long>>"
    df = spark.createDataFrame([([(5, 30, 10), (0, 33, 11), (0, 34, 11)],), ([(9, 30, 10), (2, 33, 11)],), ([],)], kind)
    rows = [r[0] and tuple(r[0]) for r in df.select(strongest(F.col("runs"))).collect()]
    assert rows == [(0, 34, 11), (9, 30, 10), None]


def test_planted_texts(spark):
    rows = [(d, " ".join(f"w{i}" for i in range(d * 7 % 90))) for d in range(200)] + [(None, "a b c"), (201, None)]
    got = {r.doc_id: r.text for r in with_planted_periods(odd_docs(spark, rows)).collect()}
    assert {d: (t or "").split() for d, t in got.items()} == {d: planted(d, (t or "").split()) for d, t in rows}


def test_query_equals_brute_force_on_documents(spark):
    from logwarden.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    expected = []
    for doc, text in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        words = planted(doc, [w.decode() for w in (text or "").encode().split()])
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((doc, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                         sha(" ".join(collapsed(words, runs)))))
    assert sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, d).collect()) == sorted(expected)
    assert sum(r[1] for r in expected) > 10
