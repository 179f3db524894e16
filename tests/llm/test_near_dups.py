import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from corpus import WORDS, odd_docs, odd_rows

from logwarden.llm import near_dups
from logwarden.llm.common import text_slices
from logwarden.llm.components import components
from logwarden.llm.near_dups import NearDups, confirmed, departures, drop_near_duplicates, near_duplicates, partners, still_open, with_both


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """Row number -> smallest doc_id reachable, by comparing all pairs of texts."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return sorted(out, key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randint(0, 9999))
    return " ".join(words)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows, n = [], 0
    for group in range(6):
        base = [rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(rng.choice([4, 30, 90]))]
        for _ in range(40 if group == 0 else 12):
            rows.append((n, edited(rng, base, rng.randint(0, 4))))
            n += 1
    rng.shuffle(rows)
    got = near_duplicates(odd_docs(spark, rows), NearDups(shingle=k, percent=percent)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows_have_defined_results(spark):
    rows = odd_rows()
    got = near_duplicates(odd_docs(spark), NearDups(shingle=3, percent=85)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 85)
    blank = [r for r in got if r.n_shingles == 0]
    assert len(blank) == 4 and all(r.kept and r.component_id == r.doc_id for r in blank)


def test_drop_keeps_one_of_each_group_and_all_columns(spark):
    docs = odd_docs(spark)
    kept = drop_near_duplicates(docs, NearDups(shingle=3, percent=85))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 13 not in ids and {4, 5, 6, 7, 9, 10, 12} <= set(ids)


def test_empty_table(spark):
    assert near_duplicates(odd_docs(spark, [])).collect() == []


def test_pruning_needs_a_clear_miss():
    steps = NearDups(shingle=3, percent=85).least_matches()
    assert all(m < 0.85 * n for n, m in steps) and [n for n, _ in steps] == sorted(n for n, _ in steps)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (3, 2), (3, 2)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_take_few_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(9)
        label = components(edges)
        assert label.rdd.getNumPartitions() <= 2
        assert {r.node: r.label for r in label.collect()} == {i: 0 for i in range(41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_members_are_labelled_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    members = [(1, 2, 2, 1), (1, 3, 3, 1), (1, 4, 4, 1), (5, 6, 6, 5), (5, 7, 7, 5), (8, 9, 9, 8)]
    state = spark.createDataFrame(members, "hub long, fp long, c long, main long")
    state = state.mapInArrow(counted, state.schema)
    label = spark.createDataFrame([(2, 1), (3, 1), (1, 1), (6, 5), (7, 5), (5, 5)], "node long, label long")
    got = sorted(tuple(r) for r in still_open(state, label, "c", "main").collect())
    assert got == [(1, 2, 1, 1), (1, 3, 1, 1), (1, 4, 4, 1)]
    assert seen.value == len(members)


def test_a_round_asks_several_partners(spark):
    p = NearDups(asks=3)
    n = 40
    state = spark.createDataFrame([(0, i, i, 0) for i in range(1, n + 1)], "hub long, fp long, c long, main long")
    # All members share one token, by which any two could be linked.
    rows = spark.createDataFrame([(0, 7, i, 100, 30, 1, True, True) for i in range(1, n + 1)],
                                 "hub long, token long, fp long, size long, n long, place long, any boolean, asks boolean")
    rounds = [{(r.a, r.b) for r in partners(rows, state, p, turn).collect()} for turn in range(2)]
    for pairs in rounds:
        assert {x for ab in pairs for x in ab} == set(range(1, n + 1))
        assert 3 * (n - 3) <= len(pairs) <= 3 * n and all(a < b for a, b in pairs)
    assert rounds[0] != rounds[1]


def test_few_pairs_take_few_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        of = spark.createDataFrame([(i, str(i)) for i in range(50)], "fp long, v string").repartition(9)
        pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 2), (4, 60)], "a long, b long")
        both = with_both(pairs, of, "v", "a", "b")
        assert both.rdd.getNumPartitions() == 1
        assert sorted((r.a, r.b, r.v_a, r.v_b) for r in both.collect()) == [(1, 2, "1", "2"), (1, 3, "1", "3"), (4, 2, "4", "2")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_members_that_differ_much_come_in_small_batches(monkeypatch):
    class Joined:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(near_dups, "with_both", lambda *args: Joined())
    rng = np.random.default_rng(1)
    sizes = [0, 1, 150_000, *[20_000] * 40, 0, 7]
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    hub = np.unique(np.concatenate([sets[2][:70_000], rng.integers(0, 2**64, 1_000, dtype=np.uint64)]))
    columns = [pa.array([-5] * len(sets)), pa.array(range(len(sets))), pa.array([i % 2 for i in range(len(sets))]), pa.array([0] * len(sets)),
               pa.array([hub.tobytes()] * len(sets)), pa.array([s.tobytes() for s in sets])]
    batch = pa.RecordBatch.from_arrays(columns, names=["hub", "fp", "c", "main", "items_a", "items_b"])
    got = list(departures(None, None)([batch, batch.slice(0, 0)]))
    assert max(b.num_rows for b in got) <= 1 << 16
    rows = pa.Table.from_batches(got).to_pandas()
    for i, (fp, own) in enumerate(rows.groupby("fp")):
        assert fp == i
        assert sorted(own.token) == sorted(np.setxor1d(hub, sets[i]).view(np.int64).tolist())
        assert set(own.drop(columns="token").itertuples(index=False, name=None)) == {(-5, i, i % 2, i % 2 == 1, len(sets[i]), len(hub), len(own))}
    assert i + 1 == len(sets)


def test_a_worker_gives_back_what_arrow_keeps(monkeypatch):
    class Joined:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    asked = []

    class Pool:
        def release_unused(self):
            asked.append(1)

    monkeypatch.setattr(near_dups, "with_both", lambda *args: Joined())
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    ids = pa.array([1, 2])
    items = pa.array([np.arange(4, dtype=np.uint64).tobytes()] * 2)
    same = pa.RecordBatch.from_arrays([ids, ids, items, items], names=["a", "b", "x", "y"])
    assert [b.num_rows for b in confirmed(None, None, NearDups())([same, same])] == [2, 2]
    assert len(asked) == 2
    assert [b.num_rows for b in text_slices(pa.RecordBatch.from_arrays([pa.array(["ab", "c", None, "def"])], names=["t"]), 0, 3)] == [3, 1]
    assert len(asked) == 3
