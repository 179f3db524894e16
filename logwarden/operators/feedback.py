"""Analyst feedback, audit log and approval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logwarden import constants as K


def valid_feedback(df: DataFrame, action: str = "analyst_action") -> DataFrame:
    """Feedback with a known action."""
    return df.where(F.col(action).isin(K.FEEDBACK_ACTIONS))


def rejected_feedback(df: DataFrame, action: str = "analyst_action") -> DataFrame:
    """Feedback with an unknown or missing action."""
    return df.where(~F.coalesce(F.col(action).isin(K.FEEDBACK_ACTIONS), F.lit(False)))


def feedback_totals(df: DataFrame, action: str = "analyst_action") -> DataFrame:
    """One row: total and count per action."""
    return df.agg(F.count(F.lit(1)).alias("total_count"),
                  *[F.count_if(F.col(action) == a).alias(f"{a}_count") for a in K.FEEDBACK_ACTIONS])


def feedback_labels(df: DataFrame, action: str = "analyst_action", label: str = "analyst_label") -> DataFrame:
    """New labels given by reclassification."""
    return (df.where((F.col(action) == "reclassify") & F.col(label).isNotNull())
            .groupBy(label).agg(F.count(F.lit(1)).alias("n")))


def feedback_by_alert(alerts: DataFrame, feedback: DataFrame, key: str = "alert_id") -> DataFrame:
    """All feedback of the given alerts, newest first."""
    return alerts.select(key).distinct().join(feedback, key).orderBy(F.desc("timestamp"))


def audit_events(df: DataFrame, actor: str | None = None, action: str | None = None,
                 limit: int | None = 100, tie: str = "event_id") -> DataFrame:
    """Audit events newest first; filters reach the scan, the limit is a top-k."""
    if actor:
        df = df.where(F.col("actor") == actor)
    if action:
        df = df.where(F.col("action") == action)
    ordered = df.orderBy(F.desc("timestamp"), F.desc(tie))
    return ordered.limit(limit) if limit else ordered


def approval_requests(df: DataFrame, state: str | None = None) -> DataFrame:
    """Approval requests, optionally of one state, newest first."""
    if state:
        df = df.where(F.col("state") == state)
    return df.orderBy(F.desc("requested_at"), F.desc("request_id"))
