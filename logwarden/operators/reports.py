"""Counts and summaries over results and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logwarden import constants as K


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, largest first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def risk_distribution(df: DataFrame, column: str = "risk_level") -> DataFrame:
    """Rows per risk level; all four levels appear."""
    return df.agg(F.explode(F.array(*[
        F.struct(F.lit(level).alias("risk_level"), F.count_if(F.col(column) == level).alias("n"))
        for level in K.RISK_LEVELS])).alias("r")).select("r.*")


def result_stats(df: DataFrame, anomaly: str = "anomaly_score", risk: str = "combined_risk_score",
                 alert: str = "requires_alert") -> DataFrame:
    """One row: records, alerts, mean and population deviation of both scores."""
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col(alert)).alias("alerts_generated"),
                  F.avg(anomaly).alias("anomaly_score_mean"), F.stddev_pop(anomaly).alias("anomaly_score_std"),
                  F.avg(risk).alias("risk_score_mean"), F.stddev_pop(risk).alias("risk_score_std"))


def counts_with_share(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and percent of all rows (a denominator of at least 1)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return counts.withColumn("pct", F.col("n") / total * 100)


def threat_level(df: DataFrame, priority: str = "priority") -> DataFrame:
    """Overall level from the counts of critical, high, medium and low alerts."""
    p = F.lower(F.col(priority))
    kinds = ["critical", "high", "medium", "low"]
    earlier = F.lit(False)
    counts = []
    for k in kinds:
        counts.append(F.count_if(p.contains(k) & ~earlier).alias(k))
        earlier = earlier | p.contains(k)
    return df.agg(F.count(F.lit(1)).alias("total"), *counts).withColumn(
        "threat_level", F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "high")
        .when(F.col("medium") > 0, "elevated").otherwise("normal"))


def priority_deltas(df: DataFrame, batch: str, priority: str = "priority") -> DataFrame:
    """Count per batch and priority, and its change since the batch before (0 if absent).

    The counts are a small table: batches times the five priorities.
    """
    counts = df.groupBy(batch).agg(*[F.count_if(F.col(priority) == p).alias(p) for p in K.PRIORITIES])
    long = counts.select(batch, F.explode(F.array(*[
        F.struct(F.lit(p).alias("priority"), F.col(f"`{p}`").alias("n")) for p in K.PRIORITIES])).alias("r")).select(batch, "r.*")
    before = F.lag("n", 1, 0).over(W.partitionBy("priority").orderBy(batch))
    return long.withColumn("delta", F.col("n") - before)


def analysis_report(alerts: DataFrame, scored: DataFrame, path: str) -> None:
    """Write alerts (JSON lines) and statistics (one JSON row) below ``path``."""
    alerts.write.mode("overwrite").json(f"{path}/alerts")
    result_stats(scored).write.mode("overwrite").json(f"{path}/stats")
