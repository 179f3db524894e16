"""Fingerprints and greedy cooldown suppression.

A row is kept when it is the first of its fingerprint or comes at least
``seconds`` after the last *kept* row.  A row whose gap to the row before it is
that long is kept in any case, so it starts a segment that does not depend on
anything earlier.  Segments are short in normal traffic and are handled many at a time
by jump pointers.  A segment without any pause can be as long as the table; it is cut into
runs, and each run answers "which is my last kept time if the last one before me
was x" for all x at once, as a step function.  Step functions of neighbouring
runs are composed level by level and the entries are handed down again, so no
task sees more than a few dozen of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logwarden import constants as K
from logwarden.functions.timestamps import micros, utc_wall
from logwarden.operators.runs import RUN, Measure, Runs, group_bounds, make_runs, running, whole_groups


def fingerprint(classification: Column, anomaly: Column, source: Column) -> Column:
    """First 16 hex digits of the hash of class, score cut to one decimal and source."""
    bucket = F.format_string("%.1f", (anomaly * 10).cast("int") / F.lit(10.0))
    return F.substring(F.sha2(F.concat_ws("|", classification, bucket,
                                          F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))), 256), 1, 16)


def _segments(runs: Runs, pause: int) -> DataFrame:
    runs = running(runs, Measure("_prev", "lag", F.col("_t")))
    fresh = F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= pause)
    return running(runs, Measure("_seg", "sum", F.when(fresh, 1).otherwise(0))).finish().select("_fp", "_seg", "_t", "_id")


def _fold(rows: DataFrame, pause: int) -> DataFrame:
    """Kept (_id) of segments that fit one task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["_fp", "_seg"]):
            yield frame[["_id"]][kept_rows(frame["_t"].to_numpy(), group_bounds(frame, ["_fp", "_seg"]), pause)]

    ordered = rows.repartition("_fp", "_seg").sortWithinPartitions("_fp", "_seg", "_t", "_id")
    return ordered.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}")


def kept_rows(t: np.ndarray, bounds: np.ndarray, pause: int) -> np.ndarray:
    """Which rows of sorted groups are kept, the first of each to begin with.

    Every row points to the first one at least ``pause`` later.  Pointers are doubled round by round, and the rows
    found so far reach as many again, so the rounds grow with the logarithm of the kept rows.
    """
    n, starts, size = len(t), bounds[:-1], np.diff(bounds)
    spans = (t[bounds[1:] - 1] - t[starts]).astype(float) + pause + 1
    if spans.sum() > 2**62:  # the groups' times do not fit behind each other
        half = len(starts) // 2
        if not half:
            return _walked(t, pause)
        cut = bounds[half]
        return np.r_[kept_rows(t[:cut], bounds[: half + 1], pause), kept_rows(t[cut:], bounds[half:] - cut, pause)]
    # Groups behind each other on one line, a pause apart.
    step = np.r_[0, (t[bounds[1:] - 1] - t[starts] + pause + 1).cumsum()[:-1]]
    line = t + np.repeat(step - t[starts], size)
    follow = np.searchsorted(line, line + pause, side="left")
    jump = np.append(np.where(follow < np.repeat(bounds[1:], size), follow, n), n)
    reached = starts
    while True:
        more = jump[reached]
        more = more[more < n]
        if not len(more):
            break
        reached = np.concatenate([reached, more])
        jump = jump[jump]
    kept = np.zeros(n, bool)
    kept[reached] = True
    return kept


def _walked(t: np.ndarray, pause: int) -> np.ndarray:
    """The same for one group of times that are centuries apart, row by row."""
    kept, last = np.zeros(len(t), bool), None
    for i, x in enumerate(t.tolist()):
        if last is None or x - last >= pause:
            kept[i], last = True, x
    return kept


def _chain(t: np.ndarray, pause: int) -> np.ndarray:
    """Index of the next kept row after each row, len(t) when it lies beyond."""
    return np.searchsorted(t, t + pause, side="left")


def _steps(start: int, bounds: np.ndarray, exits: np.ndarray, pause: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Shortest form of a step function: entry x takes the first bound >= x + pause and leaves at its exit.

    Entries lie before ``start``, so bounds past the first one at or after
    ``start + pause`` are never taken; of equal exits only the last is kept.
    """
    reach = min(int(np.searchsorted(bounds, start + pause, side="left")) + 1, len(bounds))
    bounds, exits = bounds[:reach], exits[:reach]
    final = np.append(exits[1:] != exits[:-1], True)
    return start, bounds[final], exits[final]


def _after(x: np.ndarray, bounds: np.ndarray, exits: np.ndarray, pause: int) -> np.ndarray:
    """Last kept time after a run that is entered with ``x``; ``x`` itself if the run keeps nothing."""
    at = np.searchsorted(bounds, x + pause, side="left")
    return np.where(at < len(bounds), exits[np.minimum(at, len(bounds) - 1)], x)


def run_steps(pdf: pd.DataFrame, pause: int) -> pd.DataFrame:
    """Step function of one run, from jump pointers over its rows."""
    t = np.sort(pdf["_t"].to_numpy())
    n = len(t)
    follow = _chain(t, pause)
    last = np.where(follow < n, follow, np.arange(n))
    while True:  # after k rounds ``last`` is where 2**k jumps lead
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    return _table(pdf, int(pdf[RUN].iloc[0]), *_steps(int(t[0]), t, t[last], pause))


def compose_steps(pdf: pd.DataFrame, base: int, pause: int) -> pd.DataFrame:
    """Step function of neighbouring runs taken as one."""
    pdf = pdf.sort_values("node")
    start, bounds, exits = None, None, None
    for s, b, e in zip(pdf["start"], pdf["bounds"], pdf["exits"]):
        b, e = np.asarray(b), np.asarray(e)
        if start is None:
            start, bounds, exits = int(s), b, e
            continue
        # Entries too late for the earlier runs meet this one directly.
        later = b > bounds[-1]
        start, bounds, exits = _steps(start, np.append(bounds, b[later]),
                                      np.append(_after(exits, b, e, pause), e[later]), pause)
    return _table(pdf, int(pdf["node"].iloc[0]) // base, start, bounds, exits)


def _table(pdf: pd.DataFrame, node: int, start: int, bounds: np.ndarray, exits: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"_fp": [pdf["_fp"].iloc[0]], "_seg": [pdf["_seg"].iloc[0]], "node": [node], "start": [start],
                         "bounds": [bounds], "exits": [exits]})


def entries_of(pdf: pd.DataFrame, pause: int) -> pd.DataFrame:
    """Entry of each neighbouring run, given the entry of the first one (null at the very start)."""
    pdf = pdf.sort_values("node")
    last = pdf["entry"].iloc[0]
    found = []
    for bounds, exits in zip(pdf["bounds"], pdf["exits"]):
        found.append(None if pd.isna(last) else int(last))
        if pd.isna(last):
            last = exits[0]
        else:
            last = _after(np.array([int(last)]), np.asarray(bounds), np.asarray(exits), pause)[0]
    return pd.DataFrame({"_fp": pdf["_fp"].to_numpy(), "_seg": pdf["_seg"].to_numpy(), "node": pdf["node"].to_numpy(),
                         "entry": pd.array(found, dtype="Int64")})


def kept_in_run(pdf: pd.DataFrame, pause: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["_t", "_id"])
    t = pdf["_t"].to_numpy()
    entry = pdf["entry"].iloc[0]
    follow = _chain(t, pause)
    i = 0 if pd.isna(entry) else int(np.searchsorted(t, int(entry) + pause, side="left"))
    kept = []
    while i < len(t):
        kept.append(i)
        i = int(follow[i])
    return pdf[["_id"]].iloc[kept]


def _long_segments(runs: Runs, pause: int) -> DataFrame:
    id_type = runs.df.schema["_id"].dataType.simpleString()
    segment, base = ["_fp", "_seg"], runs.base
    table = "_fp string, _seg long, node long, start long, bounds array<long>, exits array<long>"
    rows = runs.df.join(F.broadcast(runs.hot), segment, "left_semi")
    levels = [rows.groupBy(*segment, RUN).applyInPandas(lambda pdf: run_steps(pdf, pause), table)]
    # A run number has ``height`` digits; each level drops one, so a group has at most ``base`` members.
    for _ in range(runs.height - 1):
        levels.append(levels[-1].groupBy(*segment, F.floor(F.col("node") / base)).applyInPandas(
            lambda pdf: compose_steps(pdf, base, pause), table))
    above = None
    for steps in reversed(levels):
        parent = F.floor(F.col("node") / base).alias("parent")
        if above is None:
            members = steps.withColumn("entry", F.lit(None).cast("long")).withColumn("parent", parent)
        else:
            members = steps.withColumn("parent", parent).join(
                above.select(*segment, F.col("node").alias("parent"), "entry"), [*segment, "parent"])
        above = members.groupBy(*segment, "parent").applyInPandas(
            lambda pdf: entries_of(pdf, pause), "_fp string, _seg long, node long, entry long")
    # One small row per run of the cut segments, a number bounded by the marks.
    entered = rows.join(F.broadcast(above.withColumnRenamed("node", RUN)), [*segment, RUN])
    return entered.groupBy(*segment, RUN).applyInPandas(lambda pdf: kept_in_run(pdf, pause), f"_id {id_type}")


def kept_ids(df: DataFrame, fp: str, ts: str, record: str, seconds: float = K.COOLDOWN_SECONDS) -> DataFrame:
    """Identifiers of the rows that survive the cooldown."""
    pause = int(seconds * 1_000_000)
    rows = df.select(F.col(fp).alias("_fp"), micros(utc_wall(df, ts)).alias("_t"), F.col(record).alias("_id"))
    prints = make_runs(rows, ["_fp"], ["_t", "_id"])
    # Without a large fingerprint there is no large segment.
    runs = make_runs(_segments(prints, pause), ["_fp", "_seg"], ["_t", "_id"], cold=prints.hot is None)
    if runs.hot is None:
        kept = _fold(runs.df, pause)
    else:
        short = runs.df.join(F.broadcast(runs.hot), ["_fp", "_seg"], "left_anti")
        kept = _fold(short, pause).union(_long_segments(runs, pause))
    return kept.withColumnRenamed("_id", record)


def suppress(df: DataFrame, fp: str, ts: str, record: str, seconds: float = K.COOLDOWN_SECONDS,
             bypass: Column | None = None) -> DataFrame:
    """Drop suppressed rows; rows matching ``bypass`` (alerts) always pass and start no cooldown.

    A null ``bypass`` does not match.
    """
    bypass = None if bypass is None else F.coalesce(bypass, F.lit(False))
    subject = df if bypass is None else df.where(~bypass)
    kept = subject.join(kept_ids(subject, fp, ts, record, seconds), record, "left_semi")
    return kept if bypass is None else df.where(bypass).unionByName(kept)


