import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from corpus import odd_docs, odd_rows, prose

from logwarden.llm.chat import PERSPECTIVES_SQL, perspectives
from logwarden.llm.quality_gam import FEATURES, Gam, Tables, features, quality_scores, train
from logwarden.llm.shards import Cell, boundaries, minimax_shards


def least_capacity(sizes, shards):
    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        mid, n, x = (low + high) // 2, 1, 0
        for s in sizes:
            n, x = (n + 1, s) if x + s > mid else (n, x + s)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(25))
def test_capacity_is_the_least_that_any_cutting_allows(seed):
    rng = random.Random(seed)
    groups = {rng.getrandbits(64): rng.choice([1, 10, rng.randint(1, 5000)]) for _ in range(rng.choice([1, 3, 60, 3000]))}
    if seed % 4 == 0:
        groups[rng.getrandbits(64)] = sum(groups.values()) // 2
    shards = rng.choice([2, 5, 16])

    def cells_of(bits, within):
        held = defaultdict(list)
        for k, v in groups.items():
            if within is None or any(k >> 64 - c.bits == c.first >> 64 - c.bits for c in within):
                held[k >> 64 - bits].append(v)
        return sorted((Cell(k << 64 - bits, bits, sum(v), len(v), max(v)) for k, v in held.items()), key=lambda c: c.first)

    capacity, keys = boundaries(cells_of, shards)
    assert capacity == least_capacity([groups[k] for k in sorted(groups)], shards)
    assert len(keys) == shards - 1 and keys == sorted(keys)
    filled = Counter()
    for k, v in groups.items():
        filled[sum(k >= b for b in keys)] += v
    assert max(filled.values()) <= capacity


def test_shards_hold_whole_groups_and_gapless_slots(spark):
    rng = random.Random(3)
    rows = odd_rows() + [(100 + i, prose(rng, rng.randint(1, 9))) for i in range(400)] + [(900 + i, "a copy") for i in range(150)]
    got = minimax_shards(odd_docs(spark, rows), rows_per_bucket=20).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    of, slots, groups = {}, defaultdict(list), Counter()
    for r in got:
        assert of.setdefault(r.group_key, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        groups[r.group_key] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    filled = Counter()
    for r in got:
        filled[r.shard] += r["size"]
    assert max(filled.values()) <= least_capacity([groups[k] for k in sorted(groups)], 16)
    assert minimax_shards(odd_docs(spark, [])).collect() == []
    plan = minimax_shards(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_even_sizes_where_groups_are_small():
    cells = [Cell(i << 50, 14, 10, 1, 10) for i in range(1600)]
    capacity, keys = boundaries(lambda bits, within: cells, 16)
    ends = [0, *accumulate(sum(10 for c in cells if a <= c.first < b) for a, b in zip([0, *keys], [*keys, 1 << 64]))]
    assert capacity == 1000 and {b - a for a, b in zip(ends, ends[1:])} == {1000}


def test_perspectives_equal_sql(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Ann"]), prose(rng, 1)) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "user" if t % 2 else "bob", f"turn {t}") for t in range(3000)]
    rows += [(60, 1, None, "x"), (60, 1, "user", None), (60, 1, "user", "tie"), (60, 1, "user", "tie"), (60, None, "user", "first"), (None, 0, "user", "lost"), (61, 0, "user", "é😀")]
    turns = spark.createDataFrame([(*r, None, None, None) for r in rows], "conv_id long, turn long, role string, text string, head string, chunk long, perspective string")
    db = duckdb.connect()
    db.register("conversations", turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    got = perspectives(turns)
    want = db.execute(PERSPECTIVES_SQL).fetchall()
    assert got.columns == [d[0] for d in db.description]
    assert Counter(map(str, map(tuple, got.collect()))) == Counter(map(str, want))
    dialogue = sorted((r for r in got.where("conv_id = 50 and perspective = 'bob'").collect()), key=lambda r: r.start)
    text = "".join(r.rendered for r in dialogue)
    assert len(text) == dialogue[-1].stop and all(text[r.start : r.stop] == r.rendered for r in dialogue)
    assert all(text[r.target_start : r.target_stop] == f"turn {r.turn}<|im_end|>" for r in dialogue if r.trained)
    assert perspectives(turns.limit(0)).collect() == []


def test_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0)).astype(float)
    model = Tables(x, y, Gam(rounds=20))
    z = rng.normal(size=(1000, len(FEATURES))).astype(np.float32)
    assert (7, 3) in model.double and ((model.score(z) >= 0.5) == ((z[:, 3] > 0) ^ (z[:, 7] > 0))).mean() > 0.93


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(FEATURES))).astype(np.float32)
    model = Tables(x, (x[:, 0] > 0.2).astype(float), Gam(rounds=5, pair_rounds=3))
    for row, score in zip(x[:20], model.score(x[:20])):
        total = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.single, model.edges, row))
        total += sum(t[np.searchsorted(model.coarse[i], row[i], side="right"), np.searchsorted(model.coarse[j], row[j], side="right")] for (i, j), t in model.double.items())
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_held_out_accuracy_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("avg(cast(predicted = quality as int))").first()[0]
    assert got > 0.95
    known = spark.createDataFrame([(1, 1, "x"), (3, 1, "x"), (7, 0, "x"), (8, 0, "x"), (None, 1, "x"), (10, None, "x"), (1, 1, "x")], "doc_id long, quality int, text string")
    out = quality_scores(odd_docs(spark), known).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1 and len({r.score for r in out if r.doc_id in (4, 5, 6)}) == 1
    assert {r.score for r in quality_scores(odd_docs(spark), known.limit(0)).collect()} == {0.5}
    assert quality_scores(odd_docs(spark, []), known).collect() == []


def test_held_out_labels_are_never_learned(spark):
    docs = odd_docs(spark, [(i, prose(random.Random(i))) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, (i + (zlib.crc32(str(i).encode()) % 3 == 1)) % 2) for i in range(60)], "doc_id long, quality int")
    a, b = train(docs, labels), train(docs, flipped)
    assert all((x == y).all() for x, y in zip(a.single, b.single)) and a.base == b.base


def test_features_of_no_text():
    assert features([None, "", " \n"]).tolist() == [[0.0] * len(FEATURES)] * 3
