"""Ordered analytics that survive a hot key.

A window over one entity runs in one task.  When an entity (or the whole table,
for a global order) holds a large share of the rows, that task decides the run
time of the job.  Here such entities are cut into *runs*: consecutive pieces of
their order, about ``rows_per_run`` rows each.  A measure is computed inside
every run, one small row per run is carried over to the following runs, and the
two are combined.  The result equals the plain window.

Cut points are rows picked by a hash of their order columns, one in
``rows_per_run``, so they follow the data: a burst in one second is cut as well
as a year of steady traffic, and a lost task recomputes the same runs.  Their
number is checked against :data:`MAX_MARKS` before they are used.  Only keys that a
denser sample shows to be large are cut; if there is none, the plain window is used.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from logwarden.functions.timestamps import micros, utc_wall

ROWS_PER_RUN = 1_000_000
MAX_MARKS = 100_000
FANOUT = 64
RUN = "_run"


def rows_per_run(spark: SparkSession) -> int:
    return int(spark.conf.get("logwarden.rowsPerRun", str(ROWS_PER_RUN)))


@dataclass(frozen=True)
class Runs:
    """A frame with its run column; ``hot`` lists the keys that were cut."""

    df: DataFrame
    by: list[str]
    order: list[str]
    hot: DataFrame | None = None
    height: int = 1  # run numbers have this many digits ...
    base: int = FANOUT + 1  # ... in this base

    @property
    def keys(self) -> list[str]:
        return self.by + [RUN] if self.hot is not None else self.by

    def window(self):
        return W.partitionBy(*self.keys).orderBy(*self.order)

    def finish(self) -> DataFrame:
        return self.df.drop(RUN)


def _pick_marks(df: DataFrame, by: list[str], order: list[str], spread: list[str], every: int) -> list:
    """Rows of large keys hashed to 0 modulo ``every``; thinned until at most MAX_MARKS remain.

    A key is large if a sample eight times as dense, counted per key by Spark, says it has ``every`` rows.
    """
    hashed = F.xxhash64(*by, *spread)
    probe = max(1, every // 8)
    sample = df.where(F.pmod(hashed, F.lit(probe)) == 0).select(*by, *order, hashed.alias("_hash")).distinct()
    large = sample.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(2, every // probe)).drop("_n")
    while True:
        marks = sample.where(F.pmod("_hash", F.lit(every)) == 0).join(large, by, "left_semi").select(*by, *order).distinct()
        rows = marks.limit(MAX_MARKS + 1).collect()
        if len(rows) <= MAX_MARKS:
            return rows
        every *= 8


def make_runs(df: DataFrame, by: list[str], order: list[str], spread: list[str] | None = None,
              every: int | None = None, fanout: int = FANOUT, cold: bool = False) -> Runs:
    """Cut large keys of ``df`` into runs.

    ``order`` gives the order inside a key and where cuts may fall; ``spread``
    are the columns hashed to pick cuts (default ``order``).  Pass an
    identifier in ``spread`` when many rows tie on ``order``.  Key columns must
    not be null, see :func:`key_or_alone`.  ``cold`` says that an earlier check
    (:func:`is_cold`) found no large key, so the scan for cuts is skipped.
    """
    if cold:
        return Runs(df, by, order)
    spark = df.sparkSession
    every = every or rows_per_run(spark)
    rows = _pick_marks(df, by, order, spread or order, every)
    if not rows:
        return Runs(df, by, order)

    groups: dict[tuple, list[tuple]] = defaultdict(list)
    for r in rows:
        groups[tuple(r[: len(by)])].append(tuple(r[len(by):]))
    levels = _search_tree(groups, fanout)

    mark_type = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(order)])
    node_type = T.StructType([df.schema[c] for c in by] + [
        T.StructField("_node", T.LongType()), T.StructField("_marks", T.ArrayType(mark_type))])
    here = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    out = df.withColumn(RUN, F.lit(0).cast("long"))
    for nodes in levels:
        # At most MAX_MARKS marks in all levels together, so the side is small.
        table = F.broadcast(spark.createDataFrame(nodes, node_type).withColumnRenamed("_node", RUN))
        passed = F.size(F.filter("_marks", lambda m: m <= here))
        out = (out.join(table, by + [RUN], "left")
               .withColumn(RUN, F.col(RUN) * (fanout + 1) + F.coalesce(F.when(F.col("_marks").isNotNull(), passed), F.lit(0)))
               .drop("_marks"))
    hot_type = T.StructType([df.schema[c] for c in by])
    hot = spark.createDataFrame(list(groups), hot_type)
    return Runs(out.select(*df.columns, RUN), by, order, hot, len(levels), fanout + 1)


def _search_tree(groups: dict[tuple, list[tuple]], fanout: int) -> list[list[tuple]]:
    """Sorted marks -> levels of small nodes, so a row compares with few marks."""
    height, reach = 1, fanout
    longest = max(len(m) for m in groups.values())
    while reach < longest:
        height, reach = height + 1, reach * (fanout + 1) + fanout
    levels: list[list[tuple]] = [[] for _ in range(height)]

    def place(key: tuple, marks: list[tuple], level: int, node: int) -> None:
        if not marks:
            return
        if level == height - 1:
            levels[level].append(key + (node, marks))
            return
        below = _capacity(fanout, height - level - 1)
        cuts = list(range(below, len(marks), below + 1))
        levels[level].append(key + (node, [marks[i] for i in cuts]))
        start = 0
        for child, cut in enumerate(cuts + [len(marks)]):
            place(key, marks[start:cut], level + 1, node * (fanout + 1) + child)
            start = cut + 1

    for key, marks in groups.items():
        place(key, sorted(marks), 0, 0)
    return levels


def _capacity(fanout: int, height: int) -> int:
    reach = fanout
    for _ in range(height - 1):
        reach = reach * (fanout + 1) + fanout
    return reach


@dataclass(frozen=True)
class Measure:
    """A running value: ``kind`` is sum, max, last (non-null), lag or range_sum.

    ``range_sum`` includes all rows that tie with the current one; cuts must
    then not fall inside ties, so ``order`` has to be the tie columns.
    """

    name: str
    kind: str
    expr: Column


def running(runs: Runs, *measures: Measure) -> Runs:
    """Add running measures (from the start of the key up to the current row)."""
    ordered = runs.window()
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = {}
    for m in measures:
        if m.kind == "sum":
            local[m.name] = F.sum(m.expr).over(upto)
        elif m.kind == "range_sum":
            local[m.name] = F.sum(m.expr).over(ordered.rangeBetween(W.unboundedPreceding, W.currentRow))
        elif m.kind == "max":
            local[m.name] = F.max(m.expr).over(upto)
        elif m.kind == "last":
            local[m.name] = F.last(m.expr, ignorenulls=True).over(upto)
        elif m.kind == "lag":
            local[m.name] = F.lag(m.expr).over(ordered)
        else:
            raise ValueError(m.kind)
    if runs.hot is None:
        return replace(runs, df=runs.df.withColumns(local))

    # One row per run of the cut keys: as many as there are marks and keys.
    place = F.struct(*runs.order)
    totals = []
    for m in measures:
        if m.kind in ("sum", "range_sum"):
            totals.append(F.sum(m.expr).alias(f"_t_{m.name}"))
        elif m.kind == "max":
            totals.append(F.max(m.expr).alias(f"_t_{m.name}"))
        elif m.kind == "last":
            totals.append(F.max_by(m.expr, F.when(m.expr.isNotNull(), place)).alias(f"_t_{m.name}"))
        else:
            totals.append(F.max_by(m.expr, place).alias(f"_t_{m.name}"))
    summary = runs.df.join(F.broadcast(runs.hot), runs.by, "left_semi").groupBy(*runs.keys).agg(*totals)
    before = W.partitionBy(*runs.by).orderBy(RUN).rowsBetween(W.unboundedPreceding, -1)
    carried = []
    for m in measures:
        total = F.col(f"_t_{m.name}")
        if m.kind in ("sum", "range_sum"):
            carried.append(F.sum(total).over(before).alias(f"_c_{m.name}"))
        elif m.kind == "max":
            carried.append(F.max(total).over(before).alias(f"_c_{m.name}"))
        elif m.kind == "last":
            carried.append(F.last(total, ignorenulls=True).over(before).alias(f"_c_{m.name}"))
        else:
            carried.append(F.last(total).over(before).alias(f"_c_{m.name}"))
    carry = F.broadcast(summary.select(*runs.keys, *carried))

    final = {}
    for m in measures:
        mine, theirs = F.col(f"_l_{m.name}"), F.col(f"_c_{m.name}")
        if m.kind in ("sum", "range_sum"):
            final[m.name] = F.when(mine.isNull() & theirs.isNull(), None).otherwise(
                F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0)))
        elif m.kind == "max":
            final[m.name] = F.greatest(mine, theirs)
        elif m.kind == "last":
            final[m.name] = F.coalesce(mine, theirs)
        else:
            final[m.name] = F.when(F.col("_l_first") == 1, theirs).otherwise(mine)
    inner = {f"_l_{n}": c for n, c in local.items()}
    if any(m.kind == "lag" for m in measures):
        inner["_l_first"] = F.row_number().over(ordered)
    out = runs.df.withColumns(inner).join(carry, runs.keys, "left").withColumns(final)
    return replace(runs, df=out.select(*runs.df.columns, *local))


def whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from a task's frames, which are sorted by ``by``: many small groups at a time, or one large one."""
    held: list[pd.DataFrame] = []
    for frame in filter(len, frames):
        held.append(frame)
        if tuple(frame[by].iloc[-1]) == tuple(held[0][by].iloc[0]):
            continue
        together = pd.concat(held, ignore_index=True)
        cut = int(group_bounds(together, by)[-2])
        yield together.iloc[:cut].reset_index(drop=True)
        held = [together.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where the groups of a sorted frame start, and its length."""
    fresh = np.zeros(len(frame) - 1, bool)
    for c in by:
        values = frame[c].to_numpy()
        fresh |= values[1:] != values[:-1]
    return np.r_[0, np.flatnonzero(fresh) + 1, len(frame)]


def is_cold(df: DataFrame, by: list[str], order: list[str]) -> bool:
    """True if no key is large: one narrow scan that answers for several operators."""
    return not _pick_marks(df, by, order, order, rows_per_run(df.sparkSession))


def keyed(df: DataFrame, entity: str, ts: str, tie: str) -> tuple[DataFrame, list[str]]:
    """Add ``_key`` and ``_t`` (microseconds) unless the caller has; return what was added.

    Operators that share the two columns also share one shuffle.
    """
    if "_key" in df.columns:
        return df, []
    return df.withColumns({"_key": key_or_alone(F.col(entity), F.col(tie)), "_t": micros(utc_wall(df, ts))}), ["_key", "_t"]


def key_or_alone(key: Column, identifier: Column) -> Column:
    """Key text; a null key becomes a group of its own row, so nulls spread out."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), identifier.cast("string")))
