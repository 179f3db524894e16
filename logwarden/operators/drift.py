"""Drift of model outputs between the newest rows and the ones before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logwarden import constants as K


def drift_windows(history: DataFrame, ts: str, record: str, current: int = 100, baseline: int = 100) -> DataFrame:
    """Newest ``current`` rows as window 'current', the next ``baseline`` ones as 'baseline'.

    The rows are taken by a distributed top-k first; only they are numbered.
    """
    newest = history.orderBy(F.desc(ts), F.desc(record)).limit(current + baseline)
    ranked = newest.withColumn("rank", F.row_number().over(W.orderBy(F.desc(ts), F.desc(record))))
    return ranked.withColumn("window", F.when(F.col("rank") <= current, "current").otherwise("baseline"))


def window_stats(windows: DataFrame, anomaly: str = "anomaly_score", risk: str = "risk_score") -> DataFrame:
    """Per window: rows, mean and sample deviation, and the mean over all rows used for baselines."""
    stats = [F.count(F.lit(1)).alias("n")]
    for name, c in (("anomaly", anomaly), ("risk", risk)):
        stats += [F.avg(c).alias(f"{name}_mean"),
                  F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{name}_std"),
                  (F.coalesce(F.sum(c), F.lit(0.0)) / F.count(F.lit(1))).alias(f"{name}_mean_all")]
    return windows.groupBy("window").agg(*stats)


def distribution(windows: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Rows per window and value; null and '' count as Unknown."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown"))
    return windows.groupBy("window", value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def drift_level(change: Column) -> Column:
    out = None
    for bound, label in K.DRIFT_LEVELS:
        out = F.when(change < bound, label) if out is None else out.when(change < bound, label)
    return out.otherwise(K.DRIFT_TOP)


def distribution_drift(windows: DataFrame, column: str) -> DataFrame:
    """Half the summed difference of value shares between the two windows (0 to 1)."""
    counts = distribution(windows, column).groupBy("value").agg(
        F.coalesce(F.sum(F.when(F.col("window") == "current", F.col("n"))), F.lit(0)).alias("cur"),
        F.coalesce(F.sum(F.when(F.col("window") == "baseline", F.col("n"))), F.lit(0)).alias("base"))
    totals = counts.agg(F.sum("cur").alias("c"), F.sum("base").alias("b"))
    cur, base = totals.select(F.greatest("c", F.lit(1))).scalar(), totals.select(F.greatest("b", F.lit(1))).scalar()
    return counts.agg((F.coalesce(F.sum(F.abs(F.col("cur") / cur - F.col("base") / base)), F.lit(0.0)) / 2).alias("drift"))


def drift_report(history: DataFrame, ts: str, record: str, current: int = 100, baseline: int = 100,
                 anomaly: str = "anomaly_score", risk: str = "risk_score", label: str = "classification",
                 min_rows: int = K.MIN_DRIFT_ROWS, strict: bool = True) -> DataFrame:
    """One report row.

    Fewer than ``min_rows`` current rows give an empty report, fewer baseline
    rows give current statistics only.  The baseline mean divides by all rows
    when ``strict``, otherwise by the non-null ones.
    """
    windows = drift_windows(history, ts, record, current, baseline)
    s = window_stats(windows, anomaly, risk)
    pick = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c)))
    wide = s.agg(
        F.coalesce(pick("current", "n"), F.lit(0)).alias("cn"), F.coalesce(pick("baseline", "n"), F.lit(0)).alias("bn"),
        *[pick("current", f"{m}_{k}").alias(f"{m}_{k}") for m in ("anomaly", "risk") for k in ("mean", "std")],
        *[pick("baseline", f"{m}_{'mean_all' if strict else 'mean'}").alias(f"{m}_base") for m in ("anomaly", "risk")])
    wide = wide.withColumn("class_shift", distribution_drift(windows, label).scalar())
    enough = F.col("cn") >= min_rows
    both = enough & (F.col("bn") >= min_rows)
    out = {"window_size": F.when(enough, F.col("cn")).otherwise(0),
           "baseline_size": F.when(both, F.col("bn")).otherwise(0)}
    for m in ("anomaly", "risk"):
        base = F.col(f"{m}_base")
        change = F.when(both & (base > 0), (F.col(f"{m}_mean") - base) / base * 100)
        out[f"{m}_score_mean"] = F.when(enough, F.coalesce(f"{m}_mean", F.lit(0.0))).otherwise(F.lit(0.0))
        out[f"{m}_score_std"] = F.when(enough, F.coalesce(f"{m}_std", F.lit(0.0))).otherwise(F.lit(0.0))
        out[f"{m}_change_pct"] = F.coalesce(change, F.lit(0.0))
        out[f"{m}_drift"] = F.when(change.isNotNull(), drift_level(F.abs(change))).otherwise("NONE")
    out["class_drift"] = F.when(both, drift_level(F.col("class_shift") * 100)).otherwise("NONE")
    return wide.select(*[c.alias(n) for n, c in out.items()])


def save_report(report: DataFrame, path: str) -> None:
    """Append a report to the history table."""
    report.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def report_history(reports: DataFrame, limit: int = 10) -> DataFrame:
    return reports.orderBy(F.desc("timestamp")).limit(limit)


def calibrate(drift: DataFrame, feedback: DataFrame, anomaly_high: float = 0.7, critical: float = 0.85) -> DataFrame:
    """Threshold proposals (path, current, recommended, reason); never applied here.

    ``drift`` is a report row, ``feedback`` a row of :func:`feedback.feedback_totals`.
    """
    up, rejects = min(anomaly_high + 0.05, 0.85), min(critical + 0.03, 0.95)
    mean, change = F.col("anomaly_score_mean"), F.col("anomaly_change_pct")
    high = drift.where((change > 25) & (mean > 0.6) & F.lit(up != anomaly_high)).select(
        F.lit("anomaly.high_threshold").alias("path"), F.lit(anomaly_high).alias("current"),
        F.lit(up).alias("recommended"),
        F.concat(F.format_string("Anomaly scores increased %.1f%% (mean=%.2f). ", change, mean),
                 F.lit("Raising threshold to reduce false positives.")).alias("reason"))
    total, reject = F.col("total_count"), F.col("reject_count")
    crit = feedback.where((total >= 20) & (reject / total > 0.4) & F.lit(rejects != critical)).select(
        F.lit("priority.critical").alias("path"), F.lit(critical).alias("current"), F.lit(rejects).alias("recommended"),
        F.concat(F.format_string("High rejection rate (%d/%d = %.1f%%). ", reject, total, reject / total * 100.0),
                 F.lit("Raising critical threshold to reduce false positives.")).alias("reason"))
    return high.unionByName(crit)


