"""Windowed features that the configuration declares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.scalars import flag
from logwarden.functions.timestamps import micros, utc_wall
from logwarden.operators.entity import _entropy
from logwarden.operators.runs import RUN, group_bounds, make_runs, whole_groups
from logwarden.session import cut_lineage


def _slot(df: DataFrame, ts: str, seconds: int) -> Column:
    """Start of the tumbling window, in seconds since 1970."""
    return (F.floor(micros(utc_wall(df, ts)) / F.lit(seconds * 1_000_000)) * seconds).cast("long")


def window_profile(df: DataFrame, entity: str, ts: str, dst: str, port: str, size: str, seconds: int = 300) -> DataFrame:
    """Per entity and window: events, distinct destinations, port entropy, bytes."""
    rows = df.where(F.col(entity).isNotNull()).withColumn("window_start", _slot(df, ts, seconds))
    keys = [entity, "window_start"]
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.sum(size).alias("bytes_total"))
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("f"), F.col(dst).cast("string").alias("v")),
                              F.struct(F.lit(1).alias("f"), F.col(port).cast("string").alias("v"))))
    counts = rows.select(*keys, pairs.alias("p")).select(*keys, "p.*").where("v IS NOT NULL").groupBy(*keys, "f", "v").count()
    is_port = F.col("f") == 1
    kinds = counts.groupBy(*keys).agg(
        F.count(F.when(F.col("f") == 0, 1)).alias("unique_destinations"),
        _entropy(F.coalesce(F.sum(F.when(is_port, F.col("count"))), F.lit(0)),
                 F.sum(F.when(is_port, F.col("count") * F.log2("count")))).alias("port_entropy"))
    return totals.join(kinds, keys, "left")


def request_rate(sessions: DataFrame, prefix: str = "behav") -> Column:
    """Events per second in the session so far; the count itself while no time has passed."""
    n, d = F.col(f"{prefix}_events_in_session"), F.col(f"{prefix}_session_duration_seconds")
    return F.when(d > 0, n / d).otherwise(n.cast("double"))


def merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, squared deviations) of two sets of values taken together; nothing is ever subtracted from a sum."""
    n = a[0] + b[0]
    whole = np.maximum(n, 1)
    delta = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    return n, np.where(a[0] == 0, b[1], a[1] + delta * (b[0] / whole)), a[2] + b[2] + delta * delta * (a[0] * b[0] / whole)


def span_moments(parts: tuple, first: np.ndarray, end: np.ndarray) -> tuple:
    """(n, mean, squared deviations) of ``parts[first:end]`` for many spans at once.

    Spans are put together from blocks of one, two, four .. neighbours, so the work
    grows with the rows and the logarithm of the longest span.
    """
    at, left = first.copy(), np.maximum(end - first, 0)
    out = (np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at)))
    size = 1
    while left.any():
        take = np.flatnonzero(left & size)
        if len(take):
            joined = merged(tuple(c[take] for c in out), tuple(c[at[take]] for c in parts))
            for c, j in zip(out, joined):
                c[take] = j
            at[take] += size
            left[take] -= size
        if left.any():
            parts = merged(tuple(c[:-size] for c in parts), tuple(c[size:] for c in parts))
            size *= 2
    return out


def _single(v: np.ndarray) -> tuple:
    known = ~np.isnan(v)
    return known.astype(float), np.where(known, v, 0.0), np.zeros(len(v))


def _run_windows(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Per event of whole runs: for a row the moments of its run from its window's start to its time, for a window's start those up to the run's end."""
    bounds = group_bounds(pdf, ["_key", "_run"])
    t, row = pdf["_t"].to_numpy(), pdf["_row"].to_numpy()
    index = np.cumsum(np.r_[0, row])  # rows before each event
    times, values = t[row], pdf["_v"].to_numpy(dtype=float)[row]
    first, end = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        i, j = index[a], index[b]
        mine = times[i:j]
        ends = row[a:b]
        first[a:b] = i + np.searchsorted(mine, np.where(ends, t[a:b] - width, t[a:b]), side="left")
        end[a:b] = np.where(ends, i + np.searchsorted(mine, t[a:b], side="right"), j)
    n, mean, m2 = span_moments(_single(values), first, end)
    return pd.DataFrame({"_key": pdf["_key"], "_run": pdf["_run"], "_id": pdf["_id"], "_row": row, "_v": pdf["_v"], "n": n, "mean": mean, "m2": m2})


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Moments of the runs between the two runs of each asked pair, for one key; a pair has no ``n``, a run has."""
    runs = pdf[pdf["n"].notna()].sort_values("_run")
    asked = pdf[pdf["n"].isna()]
    number = runs["_run"].to_numpy()
    first = np.searchsorted(number, asked["_from"].to_numpy(dtype=np.int64), side="right")
    end = np.searchsorted(number, asked["_run"].to_numpy(), side="left")
    n, mean, m2 = span_moments(tuple(runs[c].to_numpy(dtype=float) for c in ("n", "mean", "m2")), first, end)
    return pd.DataFrame({"_key": asked["_key"], "_run": asked["_run"], "_from": asked["_from"].astype("int64"), "n": n, "mean": mean, "m2": m2})


def _by_run(events: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on frames of whole runs of events in order: a task goes through many small runs at a time and holds at most one large one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["_key", "_run"]):
            yield work(frame)

    return events.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_t").mapInPandas(run, schema)


def trailing_moments(df: DataFrame, entity: str, ts: str, field: str, tie: str, seconds: int = 86400) -> DataFrame:
    """(id, value, n, mean, m2) of the entity's trailing window (both ends and ties included) per row with entity and time.

    Rows are ordered in Spark and large entities cut into runs.  A window that begins in an earlier run consists of the end of that
    run, of whole runs and of the beginning of its own run; each is summed up where its rows are, and the
    three are merged.  Counts, means and squared deviations are only ever added up, never taken away again, so values of any size stand beside
    each other.  A null or NaN counts in no window; ``tie`` identifies rows.
    """
    width = seconds * 1_000_000
    rows = df.where(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias("_key"), micros(utc_wall(df, ts)).alias("_t"), F.col(tie).alias("_id"),
                                                      F.col(field).cast("double").alias("_v"), F.lit(True).alias("_row")).where("_t IS NOT NULL")
    starts = rows.select("_key", (F.col("_t") - F.lit(width)).alias("_t"), "_id", F.lit(None).cast("double").alias("_v"), F.lit(False).alias("_row"))
    runs = make_runs(rows, ["_key"], ["_t"], spread=["_t", "_id"])
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_key string, _run long, _id {id_type}, _row boolean, _v double, n double, mean double, m2 double"
    names = ["_id", "_v", "n", "mean", "m2"]
    if runs.hot is None:
        return _by_run(runs.df.withColumn(RUN, F.lit(0).cast("long")), lambda pdf: _run_windows(pdf, width), schema).select(*names)
    cut = make_runs(rows.unionByName(starts), ["_key"], ["_t"], spread=["_t", "_id", "_row"])
    found = cut_lineage(_by_run(cut.df, lambda pdf: _run_windows(pdf, width), schema), "run-windows")
    ends = found.where("_row")
    begins = found.where("NOT _row").select(F.col("_id").alias("_of"), F.col("_key").alias("_of_key"), F.col("_run").alias("_from"), F.struct("n", "mean", "m2").alias("before"))
    both = ends.join(begins, (F.col("_id") == F.col("_of")) & (F.col("_key") == F.col("_of_key"))).withColumn("mine", F.struct("n", "mean", "m2"))
    # One row per run and per pair of runs, both bounded by the marks.
    totals = moments(found.where("_row").select("_key", "_run", "_v"), ["_key", "_run"]).withColumn("_from", F.lit(None).cast("long"))
    asked = both.where("_from < _run - 1").select("_key", "_run", "_from").distinct().withColumns({c: F.lit(None).cast("double") for c in ("n", "mean", "m2")})
    between = totals.unionByName(asked).groupBy("_key").applyInPandas(_middle, "_key string, _run long, _from long, n double, mean double, m2 double")
    between = between.select("_key", "_run", "_from", F.struct("n", "mean", "m2").alias("middle"))
    joined = both.drop("n", "mean", "m2").join(F.broadcast(between), ["_key", "_run", "_from"], "left")
    earlier = F.when(F.col("_from") < F.col("_run"), merge_moments(F.col("before"), F.col("middle")))
    return joined.withColumn("all", merge_moments(earlier, F.col("mine"))).select("_id", "_v", "all.*")


def moments(rows: DataFrame, by: list[str], value: str = "_v") -> DataFrame:
    """n, mean and squared deviations of a column per group, null values left out."""
    n = F.count(value).cast("double")
    return rows.groupBy(*by).agg(n.alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("m2")).withColumn("m2", F.col("m2") * F.col("n"))


def merge_moments(a: Column, b: Column) -> Column:
    """Both sets of values taken together; a null side is empty."""
    n = a["n"] + b["n"]
    delta = b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
    both = F.struct(n.alias("n"), F.when(a["n"] == 0, b["mean"]).otherwise(a["mean"] + delta * share).alias("mean"),
                    (a["m2"] + b["m2"] + delta * delta * a["n"] * share).alias("m2"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def trailing_zscore(df: DataFrame, entity: str, ts: str, field: str, tie: str, seconds: int = 86400,
                    name: str = "deviation_from_baseline") -> DataFrame:
    """z-score against the entity's trailing window (both ends and the row included).

    0 without entity, time or value, with one value in the window and with equal values.  See :func:`trailing_moments`.
    """
    found = trailing_moments(df, entity, ts, field, tie, seconds)
    std = F.sqrt(F.col("m2") / (F.col("n") - 1))
    z = F.when((F.col("n") > 1) & (F.col("m2") > 0), (F.col("_v") - F.col("mean")) / std)
    scored = found.select("_id", z.alias(name))
    return df.join(scored, F.col(tie) == F.col("_id"), "left").withColumn(name, F.coalesce(name, F.lit(0.0))).select(*df.columns, name)


def rarity(df: DataFrame, entity: str, ts: str, tie: str, seconds: int = 604800, name: str = "ip_rarity_score") -> DataFrame:
    """1 minus the entity's share of all events in the trailing window."""
    from logwarden.operators.temporal import trailing_count

    mine = trailing_count(df, entity, ts, tie, seconds, "_mine")
    all_rows = trailing_count(mine.withColumn("_everyone", F.lit("all")), "_everyone", ts, tie, seconds, "_all")
    return all_rows.withColumn(name, F.when(F.col("_all") > 0, 1 - F.col("_mine") / F.col("_all")).otherwise(F.lit(0.0))).select(*df.columns, name)


def protocol_anomaly(df: DataFrame, entity: str, protocol: str, baseline: DataFrame, threshold: float = 0.05,
                     name: str = "protocol_anomaly") -> DataFrame:
    """1 when the protocol makes up less than ``threshold`` of the entity's baseline events."""
    pairs = baseline.where(F.col(entity).isNotNull()).groupBy(entity, protocol).agg(F.count(F.lit(1)).alias("_pair"))
    totals = pairs.groupBy(entity).agg(F.sum("_pair").alias("_total"))
    share = pairs.join(totals, entity).select(entity, protocol, (F.col("_pair") / F.col("_total")).alias("_share"))
    known = totals.select(entity, F.lit(True).alias("_known"))
    out = df.join(share, [entity, protocol], "left").join(known, entity, "left")
    return out.withColumn(name, flag(F.col("_known") & (F.coalesce("_share", F.lit(0.0)) < threshold))).select(*df.columns, name)


def port_scans(df: DataFrame, entity: str, ts: str, port: str, threshold: int = 50, seconds: int = 60,
               slide: int = 10) -> DataFrame:
    """Sliding windows in which an entity used at least ``threshold`` distinct ports."""
    rows = df.where(F.col(entity).isNotNull() & F.col(port).isNotNull()).select(
        entity, F.col(port).cast("string").alias("p"), _slot(df, ts, slide).alias("slot"))
    # Equal (entity, port, slot) rows collapse before the rows are spread over windows.
    starts = F.explode(F.sequence(F.col("slot") - F.lit(seconds - slide), F.col("slot"), F.lit(slide)))
    spread = rows.distinct().select(entity, "p", starts.alias("window_start"))
    return (spread.distinct().groupBy(entity, "window_start").agg(F.count(F.lit(1)).alias("unique_ports"))
            .where(F.col("unique_ports") >= threshold))


def group_alerts(df: DataFrame, ts: str, keys: list[str], seconds: int = 300) -> DataFrame:
    """Alerts per key and tumbling window with count, first and last time (microseconds)."""
    t = micros(utc_wall(df, ts))
    return df.withColumns({"window_start": _slot(df, ts, seconds), "_t": t}).groupBy("window_start", *keys).agg(
        F.count(F.lit(1)).alias("alerts"), F.min("_t").alias("first_us"), F.max("_t").alias("last_us"))
