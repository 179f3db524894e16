"""Fitted extractors, stored history and percentiles."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.operators import entity, history
from logwarden.operators.history import KnownPairs, first_time, known_pairs
from logwarden.plans import extractors
from logwarden.plans.extractors import Extractor, Feature, FeatureConfig, register
from logwarden.plans.features import FeaturePipeline, FeaturePipelineModel, build_features, definitions

CONFIG = FeatureConfig(entity="user", ts="ts", record="event_id", action="event_type", numeric=["value"], categorical=["event_type"],
                       deviation=["value"], keep_originals=True, clock_shares=True)


class Share(Extractor):
    """A foreign extractor: the action's share of the fitted events, learned as a table."""

    name = "action_share"

    def definitions(self, c):
        return [Feature("action_share", "share of the action", "foreign", minimum=0, maximum=1)]

    def fit(self, df, c):
        n = df.count()
        return {"shares": df.groupBy(c.action).agg((F.count("*") / n).alias("action_share"))}

    def transform(self, rows, batch, c, state, cold=False):
        return rows.join(state["shares"], c.action, "left")


@pytest.fixture
def foreign():
    register(Share())
    yield
    del extractors.EXTRACTORS["action_share"]


def halves(skewed):
    return skewed.where("event_id % 2 = 0"), skewed.where("event_id % 2 = 1")


def test_saved_pipeline_with_a_foreign_extractor_gives_the_same(spark, skewed, foreign, tmp_path):
    old, new = halves(skewed)
    config = FeatureConfig(**{**CONFIG.__dict__, "groups": [*CONFIG.groups, "action_share"]})
    model = FeaturePipeline(config).fit(old)
    model.save(str(tmp_path / "model"))
    loaded = FeaturePipelineModel.load(str(tmp_path / "model"))
    assert loaded.config == config
    assert {g: sorted(s) for g, s in loaded.states.items()} == {g: sorted(s) for g, s in model.states.items()}
    names = ["event_id", *[d.name for d in definitions(config)]]
    a, b = (sorted(map(tuple, m.transform(new).select(names).collect())) for m in (model, loaded))
    assert a == b and len(a) == new.count()
    shares = {r[0]: r[1] / old.count() for r in old.groupBy("event_type").count().collect()}
    assert all(r.action_share == pytest.approx(shares[r.event_type]) for r in loaded.transform(new).collect())


def test_unknown_extractors_and_text_features_are_errors(skewed, foreign):
    with pytest.raises(KeyError, match="not registered"):
        definitions(FeatureConfig(groups=["absent"]))

    class Text(Share):
        def transform(self, rows, batch, c, state, cold=False):
            return rows.withColumn("action_share", F.lit("much"))

    register(Text())
    config = FeatureConfig(**{**CONFIG.__dict__, "groups": ["action_share"]})
    with pytest.raises(ValueError, match="action_share is string"):
        build_features(skewed, config)


def test_clock_shares_and_flags_against_the_fitted_half(skewed):
    old, new = halves(skewed)
    out = build_features(new, CONFIG, old).collect()
    hours = defaultdict(int)
    for r in old.collect():
        hours[r.ts.hour] += 1
    known = {(r.user, r.event_type) for r in old.collect()}
    first = {}
    for r in sorted(new.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user is not None and (r.user, r.event_type) not in known:
            first.setdefault((r.user, r.event_type), r.event_id)
    for r in out:
        assert r.time_hour_share == pytest.approx(hours[r.ts.hour] / old.count())
        assert r.behav_is_new_action == int(r.event_id in first.values())


def events(spark, rows):
    return spark.createDataFrame(rows, "user string, act string, dst string, at timestamp_ntz, id long")


def random_events(spark, seed, n, first_id):
    import datetime as dt

    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None, ""]), rng.choice(["x", "y", None, f"z{rng.randrange(30)}"]), f"d{rng.randrange(9)}",
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(200)), first_id + i) for i in range(n)]
    return events(spark, rows), rows


FIELDS = {"act": "new_act", "dst": "new_dst"}


def brute_flags(batches):
    seen, out = set(), {}
    for rows in batches:
        for user, act, dst, at, i in sorted(rows, key=lambda r: (r[3], r[4])):
            flags = []
            for field, value in (("act", act), ("dst", dst)):
                pair = (field, user, value)
                flags.append(int(user is not None and value is not None and pair not in seen))
                if user is not None and value is not None:
                    seen.add(pair)
            out[i] = tuple(flags)
    return out


def flags_of(df):
    return {r.id: (r.new_act, r.new_dst) for r in df.collect()}


def test_batches_against_a_store(spark, tmp_path):
    made = [random_events(spark, s, 150, 1000 * s) for s in range(3)]
    want = brute_flags([rows for _, rows in made])
    store = KnownPairs(str(tmp_path / "store"), parts=8)
    got = {}
    for number, (df, _) in enumerate(made):
        for _ in range(2 if number == 1 else 1):  # batch 1 runs again after it was stored
            got |= flags_of(first_time(df, "user", FIELDS, "at", "id", store, number))
            store.append(known_pairs(df, "user", list(FIELDS)), number)
    assert got == want and sum(map(sum, got.values())) > 30
    # The first batch again sees no later one.
    assert flags_of(first_time(made[0][0], "user", FIELDS, "at", "id", store, 0)) == {i: f for i, f in want.items() if i < 1000}
    pairs = [tuple(r) for r in store.pairs(spark).select(*history.PAIR, "batch").collect()]
    assert len(set(pairs)) == len(pairs)


def test_filters_miss_nothing_and_spare_most(spark, tmp_path):
    store = KnownPairs(str(tmp_path / "store"), parts=4)
    pair = lambda a, b: spark.range(a, b).select(F.lit("f").alias("field"), F.col("id").cast("string").alias("entity"), F.lit("v").alias("value"))
    store.append(pair(0, 3000), 1)
    store.append(pair(3000, 4000), 2)
    assert store.perhaps_known(pair(0, 4000)).count() == 4000
    assert store.perhaps_known(pair(10_000, 20_000)).count() < 20
    assert store.known(pair(3990, 4010)).count() == 10
    assert store.known(pair(0, 4000), batch=2).count() == 3000
    packed = store.compact(spark, str(tmp_path / "packed"))
    assert packed.known(pair(0, 5000)).count() == 4000 and packed.pairs(spark).select("batch").distinct().count() == 1


def test_a_batch_without_filters_does_not_count(spark, tmp_path):
    store = KnownPairs(str(tmp_path / "store"), parts=4)
    one = spark.createDataFrame([("f", "a", "v")], "field string, entity string, value string")
    store.append(one, 1)
    one.withColumn("part", F.lit(0)).write.partitionBy("part").parquet(str(tmp_path / "store/pairs/batch=2"))
    assert [r.batch for r in store.pairs(spark).collect()] == [1]


def test_empty_store_and_empty_batch(spark, tmp_path):
    store = KnownPairs(str(tmp_path / "store"), parts=4)
    df, rows = random_events(spark, 9, 20, 0)
    assert flags_of(first_time(df, "user", FIELDS, "at", "id", store, 0)) == brute_flags([rows])
    assert first_time(events(spark, []), "user", FIELDS, "at", "id", store, 0).count() == 0
    store.append(known_pairs(events(spark, []), "user", list(FIELDS)), 0)
    assert store.pairs(spark).count() == 0


def test_percentiles_of_all_sizes_in_two_scans(spark):
    rng = np.random.default_rng(4)
    rows = []
    for user, n in (("big", 20_000), ("mid", 900), ("one", 1), (None, 50)):
        for _ in range(n):
            rows.append((user, float(rng.lognormal(3, 2)), float(rng.integers(0, 4)), None if user != "mid" else float(rng.normal())))
    df = spark.createDataFrame(rows, "user string, skewed double, ties double, gaps double").repartition(7)
    percents = [1, 25, 50, 75, 95, 100]
    out = entity.percentile_profiles(df, "user", ["skewed", "ties", "gaps"], percents, whole=500)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2
    got = {r.user: r for r in out.collect()}
    assert set(got) == {"big", "mid", "one"}
    for user, r in got.items():
        for c, f in ((1, "skewed"), (2, "ties"), (3, "gaps")):
            values = [x[c] for x in rows if x[0] == user and x[c] is not None]
            want = np.percentile(values, percents) if values else [0.0] * len(percents)
            assert [r[f"stat_{f}_p{p}"] for p in percents] == pytest.approx(list(want))


def test_sorted_input_keeps_ranks_inside_their_brackets(spark):
    df = spark.range(0, 300_000, 1, 16).select(F.lit("u").alias("user"), F.col("id").cast("double").alias("v"))
    r = entity.percentile_profile(df, "user", "v", [1, 50, 99]).first()
    assert (r.stat_v_p1, r.stat_v_p50, r.stat_v_p99) == pytest.approx(np.percentile(np.arange(300_000), [1, 50, 99]))


def test_rows_of_large_entities_are_not_dealt_by_entity_and_small_ones_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(entity, "TASK_VALUES", 100, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit("big")).otherwise((F.col("id") % 50).cast("string")).alias("user"),
                                      (F.col("id") * 7919 % 3001).cast("double").alias("v"))
        out = entity.percentile_profiles(df, "user", ["v"], [10, 50], whole=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        values = {u: [] for u in ["big", *map(str, range(50))]}
        for r in df.collect():
            values[r.user].append(r.v)
        got = {r.user: (r.stat_v_p10, r.stat_v_p50) for r in out.collect()}
        assert got == {u: pytest.approx(tuple(np.percentile(v, [10, 50]))) for u, v in values.items()}
        assert ", 11), REPARTITION_BY_NUM" in plan  # 1,000 values of small entities, 100 a task
        assert "BroadcastHashJoin [user" in plan and "BuildRight" in plan  # brackets go to the rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
