"""Sessions, first-time flags and deviation from entity baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden import constants as K
from logwarden.functions.scalars import flag
from logwarden.operators.runs import Measure, key_or_alone, keyed, make_runs, running


def sessions(df: DataFrame, entity: str, ts: str, tie: str, timeout: float = K.SESSION_TIMEOUT_SECONDS,
             prefix: str = "behav", cold: bool = False) -> DataFrame:
    """Session number, events so far and seconds so far, per entity.

    A gap of more than ``timeout`` seconds starts a new session; numbers start
    at 0.  Rows without entity get zeros.
    """
    rows, added = keyed(df, entity, ts, tie)
    runs = running(make_runs(rows, ["_key"], ["_t", tie], cold=cold),
                   Measure("_prev", "lag", F.col("_t")), Measure("_rn", "sum", F.lit(1)))
    cut = (F.col("_t") - F.col("_prev")) > F.lit(int(timeout * 1_000_000))
    start = cut | F.col("_prev").isNull()
    runs = running(runs, Measure("_session", "sum", flag(cut)),
                   Measure("_from", "max", F.when(start, F.col("_t"))),
                   Measure("_from_rn", "max", F.when(start, F.col("_rn"))))
    known = F.col(entity).isNotNull()
    number = lambda c: F.when(known, c).otherwise(0).cast("long")
    return runs.finish().withColumns({
        f"{prefix}_session_id": number(F.col("_session")),
        f"{prefix}_events_in_session": number(F.col("_rn") - F.col("_from_rn") + 1),
        f"{prefix}_session_duration_seconds": F.when(
            known, F.coalesce(F.greatest((F.col("_t") - F.col("_from")) / F.lit(1e6), F.lit(0.0)), F.lit(0.0))
        ).otherwise(F.lit(0.0)),
    }).drop("_prev", "_rn", "_session", "_from", "_from_rn", *added)


def known_values(df: DataFrame, entity: str, field: str) -> DataFrame:
    """Baseline: the distinct (entity, value) pairs seen before."""
    return (df.where(F.col(entity).isNotNull() & F.col(field).isNotNull())
            .select(F.col(entity).cast("string").alias("entity"), F.col(field).cast("string").alias("value"))
            .distinct())


def first_seen(df: DataFrame, entity: str, field: str, ts: str, tie: str, name: str,
               baseline: DataFrame | None = None, cold: bool = False) -> DataFrame:
    """1 for the entity's first event with this value, unless the baseline has it."""
    rows = keyed(df, entity, ts, tie)[0].withColumn("_value", key_or_alone(F.col(field), F.col(tie)))
    runs = running(make_runs(rows, ["_key", "_value"], ["_t", tie], cold=cold), Measure("_prev", "lag", F.lit(1)))
    out, new = runs.finish(), F.col("_prev").isNull() & F.col(field).isNotNull() & F.col(entity).isNotNull()
    if baseline is not None:
        seen = baseline.select(F.col("entity").alias("_key"), F.col("value").alias("_value"),
                               F.lit(True).alias("_seen"))
        out = out.join(seen, ["_key", "_value"], "left")
        new = new & F.col("_seen").isNull()
    return out.withColumn(name, flag(new)).select(*df.columns, name)


def deviation_baseline(df: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """Mean and sample deviation of each field per entity (0 with a single value)."""
    stats = []
    for f in fields:
        x = F.col(f).try_cast("double")
        stats += [F.avg(x).alias(f"_mean_{f}"),
                  F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0).alias(f"_std_{f}")]
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*stats)


def deviation(df: DataFrame, entity: str, fields: list[str], baseline: DataFrame,
              threshold: float = K.DEVIATION_THRESHOLD, prefix: str = "behav") -> DataFrame:
    """z-score and flag per field against the baseline, and the mean absolute score.

    Entities without a baseline, and fields without spread, score 0.
    """
    joined = df.join(baseline, entity, "left")
    scores, columns = [], {}
    for f in fields:
        x = F.col(f).try_cast("double")
        std = F.col(f"_std_{f}")
        z = F.when(x.isNotNull(), F.when(std > 0, (x - F.col(f"_mean_{f}")) / std).otherwise(F.lit(0.0)))
        columns[f"{prefix}_{f}_zscore"] = F.coalesce(z, F.lit(0.0))
        columns[f"{prefix}_{f}_is_anomalous"] = flag(F.abs(z) > threshold)
        scores.append(F.abs(z))
    present = F.array_compact(F.array(*scores))
    total = F.aggregate(present, F.lit(0.0), lambda a, b: a + b)
    columns[f"{prefix}_deviation_score"] = F.when(F.size(present) > 0, total / F.size(present)).otherwise(F.lit(0.0))
    helpers = [c for c in baseline.columns if c != entity]
    return joined.withColumns(columns).drop(*helpers)
