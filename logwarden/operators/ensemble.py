"""Fusion of anomaly score and classification into risk, priority and text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logwarden import constants as K
from logwarden.functions.scalars import banded, compact_list, lookup


@dataclass(frozen=True)
class Scoring:
    """Weights and thresholds; the defaults are the fixed ones."""

    anomaly_weight: float = K.ANOMALY_WEIGHT
    class_weight: float = K.CLASS_WEIGHT
    anomaly_medium: float = K.ANOMALY_MEDIUM
    anomaly_high: float = K.ANOMALY_HIGH
    confidence_min: float = K.CONFIDENCE_MIN
    confidence_medium: float = K.CONFIDENCE_MEDIUM
    confidence_high: float = K.CONFIDENCE_HIGH
    risk_medium: float = K.RISK_MEDIUM
    risk_high: float = K.RISK_HIGH
    risk_critical: float = K.RISK_CRITICAL


def threat_category(classification: Column) -> Column:
    return F.when(classification.isin(K.CLASSES), classification).otherwise("Unknown")


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * F.lit(100.0))


def priority_rank(priority: Column) -> Column:
    """0 for P0 up to 4 for P4, 5 for anything else."""
    return lookup({p: i for i, p in enumerate(K.PRIORITIES)}, priority, 5)


def score(df: DataFrame, anomaly: str = "anomaly_score", label: str = "classification",
          confidence: str = "class_confidence", config: Scoring = Scoring()) -> DataFrame:
    """Add threat category, contributions, risk score and level, priority, action and reasons."""
    s, a, c, cls = config, F.col(anomaly), F.col(confidence), F.col(label)
    # Each step refers to the one before it once where it can: Spark inlines
    # these expressions into filters, and repeated parts would multiply.
    sure, unsure_share = c >= s.confidence_min, F.lit(K.UNSURE_FACTOR)
    severity = F.lit(None).cast("double")
    for name, value in K.THREAT_SEVERITY.items():
        if name != "Unknown":
            severity = F.coalesce(severity, F.when(cls == name, F.lit(value)))
    base = df.withColumn("threat_category", threat_category(cls)).withColumn(
        "threat_severity", F.coalesce(severity, F.lit(K.THREAT_SEVERITY["Unknown"])))
    base = base.withColumn("classification_contribution",
                           F.col("threat_severity") * F.when(sure, c).otherwise(unsure_share))
    severe, benign = cls.isin(K.SEVERE_THREATS), cls == "Benign"
    boost = severe & (a >= s.anomaly_medium)
    calm = benign & (c >= s.confidence_high) & (a < s.anomaly_medium)
    raw = F.lit(s.anomaly_weight) * a + F.lit(s.class_weight) * F.col("classification_contribution")
    factor = F.when(boost, K.SEVERE_BOOST).when(calm, K.BENIGN_FACTOR).otherwise(1.0)
    # least() skips nulls, so only boosted scores are capped.
    scored = base.withColumn("combined_risk_score", F.least(F.when(boost, F.lit(1.0)), raw * factor))
    risk, threat = F.col("combined_risk_score"), F.col("threat_category")
    scored = scored.withColumns({
        "risk_level": banded(risk, [(s.risk_critical, "Critical"), (s.risk_high, "High"), (s.risk_medium, "Medium")],
                             "Low", strict=False),
        "alert_priority": F.when(risk >= s.risk_critical, "P0-Critical")
        .when((risk >= s.risk_high) & severe, "P1-High").when(risk >= s.risk_high, "P2-Medium")
        .when((risk >= s.risk_medium) & (c >= s.confidence_medium), "P3-Low").otherwise("P4-Info"),
        # P0 to P2 are exactly the critical and high risks.
        "requires_alert": risk >= s.risk_high,
    })
    level = F.col("risk_level")
    return scored.withColumns({
        "suggested_action": suggested_action(level, threat),
        "reasoning": compact_list(
            (sure & ~benign, F.concat(F.lit("Classified as "), cls, F.lit(" with "), percent(c), F.lit(" confidence"))),
            (~sure, F.concat(F.lit("Low classification confidence ("), percent(c), F.lit(")"))),
            (a >= s.anomaly_high, F.format_string("High anomaly score (%.2f)", a)),
            ((a >= s.anomaly_medium) & (a < s.anomaly_high), F.format_string("Moderate anomaly score (%.2f)", a)),
            (boost, F.lit("Risk boosted: severe threat with anomalous behavior")),
            (calm, F.lit("Risk reduced: confident benign with normal behavior")),
        ),
        "contributing_factors": F.create_map(
            F.lit("threat_severity"), F.col("threat_severity"),
            F.lit("classification_contribution"), F.col("classification_contribution"),
            F.lit("anomaly_contribution"), a),
    })


def suggested_action(level: Column, threat: Column) -> Column:
    high = F.when(threat == "", "")
    for name, text in K.ACTION_HIGH.items():
        high = high.when(threat == name, text)
    return (F.when(level == "Critical", K.ACTION_CRITICAL).when(level == "High", high.otherwise(K.ACTION_HIGH_OTHER))
            .when(level == "Medium", K.ACTION_MEDIUM).otherwise(K.ACTION_LOW))


def simple_risk_level(anomaly: Column, label: Column, confidence: Column) -> Column:
    """Risk level straight from the two models, without fusion."""
    attack = label != "Benign"
    return (F.when((anomaly > 0.8) & attack & (confidence > 0.7), "Critical")
            .when((anomaly > 0.7) | (label.isin(K.SEVERE_THREATS) & (confidence > 0.5)), "High")
            .when((anomaly > 0.5) | (attack & (confidence > 0.5)), "Medium")
            .otherwise("Low"))


def is_anomaly(anomaly: Column, threshold: float = K.ANOMALY_MEDIUM) -> Column:
    return F.when(anomaly >= threshold, 1).otherwise(0)
