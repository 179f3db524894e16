"""Operators that cut large keys must give the same rows as plain windows and as brute force."""

import bisect
import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.operators import behavior, cooldown, entity, missing, runs, temporal, windows


def rows(df):
    """Rows in order; doubles that are merged in another order may differ in their last digits."""
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


OPERATORS = {
    "delta_entity": lambda d: temporal.delta_entity(d, "user", "ts", "event_id"),
    "delta_global": lambda d: temporal.delta_global(d, "ts", "event_id"),
    "trailing_count": lambda d: temporal.trailing_count(d, "user", "ts", "event_id"),
    "sessions": lambda d: behavior.sessions(d, "user", "ts", "event_id"),
    "first_seen": lambda d: behavior.first_seen(d, "user", "event_type", "ts", "event_id", "new"),
    "forward_fill": lambda d: missing.forward_fill(
        d.withColumn("x", F.when(F.col("event_id") % 3 == 0, F.col("value"))), "x", ["ts", "event_id"]),
    "trailing_zscore": lambda d: windows.trailing_zscore(d, "user", "ts", "value", "event_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_cut_keys_match_plain_windows(spark, skewed, name):
    plain = rows(OPERATORS[name](skewed))
    spark.conf.set("logwarden.rowsPerRun", "7")
    try:
        assert rows(OPERATORS[name](skewed)) == plain
    finally:
        spark.conf.unset("logwarden.rowsPerRun")


def test_search_tree_gives_the_rank_of_each_row(spark):
    df = spark.range(500).select(F.lit("a").alias("k"), F.col("id").alias("o"))
    cut = runs.make_runs(df, ["k"], ["o"], every=5, fanout=3)
    out = sorted((r["o"], r[runs.RUN]) for r in cut.df.collect())
    numbers = [n for _, n in out]
    assert numbers == sorted(numbers)
    marks = spark.range(500).where(F.pmod(F.xxhash64(F.lit("a"), F.col("id")), F.lit(5)) == 0).count()
    assert marks > 20 and len(set(numbers)) in (marks, marks + 1)


def test_marks_are_thinned_below_the_limit(spark, monkeypatch):
    monkeypatch.setattr(runs, "MAX_MARKS", 10)
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("o"))
    assert len(runs._pick_marks(df, ["k"], ["o"], ["o"], 2)) <= 10


def test_trailing_count_brute_force(skewed, small_runs):
    out = [r.asDict() for r in temporal.trailing_count(skewed, "user", "ts", "event_id").collect()]
    times = defaultdict(list)
    for r in out:
        times[r["user"]].append(r["ts"])
    for t in times.values():
        t.sort()
    for r in out:
        t = times[r["user"]]
        want = 0 if r["user"] is None else bisect.bisect_right(t, r["ts"]) - bisect.bisect_left(t, r["ts"] - dt.timedelta(hours=1))
        assert r["time_events_per_hour"] == want


def test_percentiles_of_cut_keys(skewed, small_runs):
    got = {r["user"]: r for r in entity.percentile_profile(skewed, "user", "value").collect()}
    values = defaultdict(list)
    for r in skewed.collect():
        values[r["user"]].append(r["value"])
    assert set(got) == set(values) - {None}
    for user, r in got.items():
        want = np.percentile(values[user], [25, 50, 75, 95])
        assert [r[f"stat_value_p{p}"] for p in (25, 50, 75, 95)] == pytest.approx(list(want))


@pytest.mark.parametrize("seconds", [60, 600, 86400])
@pytest.mark.parametrize("every,fanout", [(None, 64), ("6", 64), ("4", 3)])
def test_cooldown_against_a_loop(spark, skewed, seconds, every, fanout, monkeypatch):
    make = runs.make_runs
    # A small fan-out gives several levels of step functions.
    monkeypatch.setattr(cooldown, "make_runs", lambda *a, **k: make(*a, fanout=fanout, **k))
    if every:
        spark.conf.set("logwarden.rowsPerRun", every)
    try:
        d = skewed.withColumn("fp", (F.col("event_id") % 2).cast("string"))
        got = sorted(r[0] for r in cooldown.kept_ids(d, "fp", "ts", "event_id", seconds).collect())
    finally:
        spark.conf.unset("logwarden.rowsPerRun")
    last, want = {}, []
    for fp, ts, i in sorted((r["fp"], r["ts"], r["event_id"]) for r in d.collect()):
        if fp not in last or (ts - last[fp]).total_seconds() >= seconds:
            last[fp] = ts
            want.append(i)
    assert got == sorted(want)


def test_suppression_lets_alerts_pass(spark):
    t = dt.datetime(2026, 1, 1)
    data = [(i, "x", t + dt.timedelta(seconds=10 * i), i % 4 == 0) for i in range(20)]
    df = spark.createDataFrame(data, "id long, fp string, ts timestamp_ntz, alert boolean")
    kept = {r["id"] for r in cooldown.suppress(df, "fp", "ts", "id", 60, bypass=F.col("alert")).collect()}
    assert {i for i in range(20) if i % 4 == 0} <= kept
    assert kept - {0, 4, 8, 12, 16} == {1, 7, 13, 19}


def test_session_gap_of_exactly_the_timeout_stays(spark):
    t = dt.datetime(2026, 1, 2, 10)
    data = [(1, "a", t), (2, "a", t + dt.timedelta(seconds=1800)), (3, "a", t + dt.timedelta(seconds=3601)), (4, None, t)]
    df = spark.createDataFrame(data, "id long, e string, ts timestamp_ntz")
    out = {r["id"]: r for r in behavior.sessions(df, "e", "ts", "id").collect()}
    assert [out[i]["behav_session_id"] for i in (1, 2, 3, 4)] == [0, 0, 1, 0]
    assert [out[i]["behav_events_in_session"] for i in (1, 2, 3, 4)] == [1, 2, 1, 0]
    assert out[2]["behav_session_duration_seconds"] == 1800.0


def test_median_fill_with_cut_values(skewed, small_runs):
    d = skewed.withColumn("x", F.when(F.col("event_id") % 4 > 0, F.col("value")))
    values = sorted(r["x"] for r in d.collect() if r["x"] is not None)
    assert missing.fit_fills(d, {"x": "fill_median"}).first()[0] == pytest.approx(float(np.median(values)))


def test_step_functions_compose(spark):
    """Entering two runs one after the other equals entering their composition."""
    import pandas as pd

    rng = np.random.default_rng(3)
    for pause in (3, 10, 40):
        for _ in range(30):
            cuts = [np.sort(rng.integers(100, 160, size=rng.integers(1, 12))), np.sort(rng.integers(160, 220, size=rng.integers(1, 12)))]
            frames = [pd.DataFrame({"_fp": "x", "_seg": 0, "_t": t, runs.RUN: i}) for i, t in enumerate(cuts)]
            tables = pd.concat([cooldown.run_steps(f, pause) for f in frames])
            whole = cooldown.compose_steps(tables, 65, pause).iloc[0]
            start = int(cuts[0][0])
            for x in range(start - pause - 2, start):
                last = x
                for t in np.concatenate(cuts):
                    if t - last >= pause:
                        last = int(t)
                got = cooldown._after(np.array([x]), whole["bounds"], whole["exits"], pause)[0]
                assert got == last


def brute_zscores(rows, seconds):
    """id -> z by visiting the whole window of every row."""
    out = {}
    for user, t, i, v in rows:
        window = [x for u, s, _, x in rows if u == user and s is not None and t is not None and x is not None and 0 <= (t - s).total_seconds() <= seconds]
        std = np.std(window, ddof=1) if user is not None and v is not None and len(window) > 1 else 0
        out[i] = (v - np.mean(window)) / std if std > 0 else 0.0
    return out


@pytest.mark.parametrize("every", [None, "9", "40"])
def test_trailing_zscore_beside_outliers(spark, every):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(500):
        user = rng.choice(["hot", "hot", "b", "c", None])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 3000)) // 5 * 5)
        value = None if rng.random() < 0.05 else 1e12 if rng.random() < 0.01 else float(rng.normal(1e6, 3))
        rows.append((user, None if rng.random() < 0.02 else at, i, value))
    df = spark.createDataFrame(rows, "user string, ts timestamp_ntz, id long, value double")
    if every:
        spark.conf.set("logwarden.rowsPerRun", every)
    try:
        got = {r.id: r.deviation_from_baseline for r in windows.trailing_zscore(df, "user", "ts", "value", "id", 7200).collect()}
    finally:
        spark.conf.unset("logwarden.rowsPerRun")
    assert got == pytest.approx(brute_zscores(rows, 7200), abs=1e-6)


def test_an_outlier_later_changes_no_earlier_score(spark):
    calm = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, float(50 + i % 7)) for i in range(30)]
    schema = "user string, ts timestamp_ntz, id long, value double"
    score = lambda rows: {r.id: r.deviation_from_baseline for r in windows.trailing_zscore(spark.createDataFrame(rows, schema), "user", "ts", "value", "id").collect()}
    alone = score(calm)
    beside = score([*calm, ("a", dt.datetime(2024, 3, 1), 99, 1e12)])
    assert {i: beside[i] for i in alone} == alone and any(abs(z) > 1 for z in alone.values())


def test_kept_rows_against_a_walk():
    rng = np.random.default_rng(3)
    for scale in (1, 10, 10**17):
        groups = [np.sort(rng.integers(0, 50, rng.integers(1, 40))) * scale for _ in range(30)]
        want = []
        for t in groups:
            last = None
            for x in t.tolist():
                want.append(last is None or x - last >= 7 * scale)
                last = x if want[-1] else last
        bounds = np.r_[0, np.cumsum([len(t) for t in groups])]
        assert cooldown.kept_rows(np.concatenate(groups), bounds, 7 * scale).tolist() == want


def test_cooldown_of_one_segment_grows_with_its_rows():
    import time

    def seconds(n):
        t = np.arange(n) * 1_000_000
        best = []
        for _ in range(5):
            start = time.perf_counter()
            assert cooldown.kept_rows(t, np.array([0, n]), 2_000_000).sum() == n // 2
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(800_000) < 3 * seconds(400_000)


def test_whole_groups_of_any_frames():
    import pandas as pd

    keys = pd.DataFrame({"a": ["x"] * 5 + ["y"] * 1 + ["z"] * 9, "b": [0] * 3 + [1] * 2 + [0] + [2] * 9, "v": range(15)})
    for size in (1, 2, 4, 15):
        frames = [keys[i : i + size] for i in range(0, 15, size)] + [keys[:0]]
        out = list(runs.whole_groups(iter(frames), ["a", "b"]))
        assert pd.concat(out)["v"].tolist() == list(range(15))
        ends = [tuple(f[["a", "b"]].iloc[0]) for f in out[1:]]
        assert all(tuple(f[["a", "b"]].iloc[-1]) != e for f, e in zip(out, ends))
