import math
import random
from collections import Counter, defaultdict

import pytest
from corpus import odd_docs, odd_rows
from pyspark.sql import functions as F

from logwarden.llm.mixing import Mix, decided, mix, mixed

SCHEMA = "doc_id long, source string, text string, extra string, size string, of string, n string, hash string, tilt string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", *[None] * 5) for r in rows], SCHEMA)


def corpus(seed, sources=("b", "a", None, "é", "a0"), n=400):
    rng = random.Random(seed)
    return [(i, rng.choices(sources, [30, 8, 3, 2, 1])[0], " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.lognormvariate(3, 1.3))))) for i in range(n)]


def brute_targets(rows, p=Mix()):
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), p.share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if weight[s] * level > p.most * sizes[s]}
        if not stop:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: p.most * sizes[s] for s in stop}
        left -= sum(p.most * sizes[s] for s in stop)
        open_ -= stop
    return sizes, target


def brute_rates(rows, p=Mix()):
    """(source, size) -> rate: the odds are exp(tilt * size), with the tilt by halving."""
    sizes, target = brute_targets(rows, p)
    by_source = defaultdict(Counter)
    for _, source, text in rows:
        by_source[source][len((text or "").encode().split())] += 1
    out = {}
    for source, cells in by_source.items():
        unit = sizes[source] / sum(cells.values())

        def rate(size, tilt):
            return p.most / (1 + math.exp(-tilt * size / unit)) if unit else 1.0

        low, high = -700.0, 700.0
        for _ in range(200):
            tilt = (low + high) / 2
            try:
                much = sum(n * size * rate(size, tilt) for size, n in cells.items())
            except OverflowError:
                much = 0
            low, high = (tilt, high) if much < target[source] else (low, tilt)
        full = target[source] >= p.most * sizes[source] > 0
        out |= {(source, size): p.most if full else rate(size, tilt) for size in cells}
    return out


def holds(rows, got, p=Mix()):
    sizes, target = brute_targets(rows, p)
    rate = brute_rates(rows, p)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(d), str(s), len((t or "").encode().split())) for d, s, t in rows)
    taken, longest, copies = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= p.most and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.rate == pytest.approx(rate[r.source, r.size], abs=1e-6)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        copies[r.source].append((r.size, r.copies, r.rate))
    for s in taken:
        assert abs(taken[s] - target[s]) <= longest[s] + 1e-6
        total = 0.0
        ends = {}
        for size, c, rate_ in sorted(copies[s]):
            total += c - rate_
            ends[size] = total
        assert all(abs(e) < 1 + 1e-6 for e in ends.values())


def test_targets_rates_and_copies(spark):
    rows = corpus(1)
    holds(rows, mix(docs_of(spark, rows)).collect())


def test_one_source_and_no_words(spark):
    holds([(i, "s", "a b" * i) for i in range(30)], mix(docs_of(spark, [(i, "s", "a b" * i) for i in range(30)])).collect())
    got = mix(docs_of(spark, [(1, "s", ""), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_odd_rows_repeats_and_empty_table(spark):
    rows = [(d, ("x", "y", None)[i % 3], t) for i, (d, t) in enumerate(odd_rows())]
    got = mix(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, s, _ in rows)
    assert mix(docs_of(spark, [])).collect() == []
    assert mix(odd_docs(spark).withColumn("source", F.lit("s"))).count() == len(odd_rows())


def test_large_cells_and_many_equal_rows(spark):
    p = Mix(rows_per_cell=16)
    rows = [(i, "b", "one two three") for i in range(500)] + [(None, "b", "one two three four")] * 200 + [(i, "a", "x " * (i % 7)) for i in range(300)]
    got = mix(docs_of(spark, rows), p).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(t.split())) for d, s, t in rows)
    sizes, target = brute_targets(rows, p)
    for s in "ab":
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(target[s], rel=0.02)
    equal = {r.copies for r in got if r.doc_id is None}
    assert max(equal) - min(equal) <= 1


def test_reruns_and_other_partitions_agree(spark):
    rows = corpus(2)
    first = sorted((r.doc_id, r.copies) for r in mix(docs_of(spark, rows)).collect())
    again = sorted((r.doc_id, r.copies) for r in mix(docs_of(spark, rows[::-1]).repartition(7)).collect())
    assert first == again


def test_mixed_corpus_holds_the_copies(spark):
    rows = corpus(3, n=120) + [(500, "a", "twice the same"), (500, "a", "twice the same"), (501, None, None)]
    docs = docs_of(spark, rows)
    want = Counter()
    for r in decided(docs).collect():
        want[r.doc_id] += r.total
    out = mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_no_python_in_the_plan(spark):
    plan = mix(docs_of(spark, corpus(1, n=20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
