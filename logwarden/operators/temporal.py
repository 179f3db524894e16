"""Time deltas, trailing counts and calendar baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.timestamps import micros, utc_wall
from logwarden.operators.runs import Measure, keyed, make_runs, running


def _delta(seconds: Column, present: Column) -> Column:
    return F.when(present, F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def delta_entity(df: DataFrame, entity: str, ts: str, tie: str,
                 name: str = "time_delta_entity_seconds", cold: bool = False) -> DataFrame:
    """Seconds since the entity's previous event; 0 for the first and for null entities."""
    rows, added = keyed(df, entity, ts, tie)
    runs = running(make_runs(rows, ["_key"], ["_t", tie], cold=cold), Measure("_prev", "lag", F.col("_t")))
    seconds = (F.col("_t") - F.col("_prev")) / F.lit(1e6)
    out = runs.finish().withColumn(name, _delta(seconds, F.col(entity).isNotNull()))
    return out.drop("_prev", *added)


def delta_global(df: DataFrame, ts: str, tie: str, name: str = "time_delta_global_seconds") -> DataFrame:
    """Seconds since the previous event of the whole table."""
    rows = df.withColumns({"_all": F.lit(0), "_at": micros(utc_wall(df, ts))})
    runs = running(make_runs(rows, ["_all"], ["_at", tie]), Measure("_prev", "lag", F.col("_at")))
    seconds = (F.col("_at") - F.col("_prev")) / F.lit(1e6)
    return runs.finish().withColumn(name, _delta(seconds, F.lit(True))).drop("_all", "_at", "_prev")


def trailing_count(df: DataFrame, entity: str, ts: str, tie: str, seconds: int = 3600,
                   name: str = "time_events_per_hour", cold: bool = False) -> DataFrame:
    """Events of the entity in the last ``seconds``, both ends included.

    Every event adds 1 at its time and takes it away just after it expires; a
    running sum over both gives the count.  A sliding frame would instead visit
    the whole hour again for each event.
    """
    live = keyed(df, entity, ts, tie)[0].withColumn("_step", F.lit(1))
    gone = live.where(F.col("_t").isNotNull() & F.col(entity).isNotNull()).select(
        "_key", (F.col("_t") + F.lit(seconds * 1_000_000 + 1)).alias("_t"), F.lit(-1).alias("_step"), tie)
    both = live.unionByName(gone, allowMissingColumns=True)
    runs = running(make_runs(both, ["_key"], ["_t"], spread=["_t", tie], cold=cold),
                   Measure("_count", "range_sum", F.col("_step")))
    counted = F.when(F.col(entity).isNotNull() & F.col("_t").isNotNull(), F.col("_count"))
    return (runs.finish().where("_step = 1").withColumn(name, F.coalesce(counted, F.lit(0)).cast("long"))
            .select(*df.columns, name))


def clock_distribution(df: DataFrame, ts: str, part: str = "hour") -> DataFrame:
    """Share of events per hour (24 rows) or weekday (7 rows), empty bins included."""
    wall = utc_wall(df, ts)
    bins, value = (24, F.hour(wall)) if part == "hour" else (7, F.weekday(wall))
    counts = df.select(value.cast("long").alias(part)).where(F.col(part).isNotNull()).groupBy(part).count()
    axis = df.sparkSession.range(bins).withColumnRenamed("id", part)
    # At most 24 rows on either side.
    filled = axis.join(F.broadcast(counts), part, "left").withColumn("n", F.coalesce("count", F.lit(0)))
    total = counts.agg(F.sum("count")).scalar()
    return filled.select(part, (F.col("n") / total).alias("share"))
