"""Alerts: generation, enrichment, selection, explanation and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden import constants as K
from logwarden.functions.scalars import banded, compact_list
from logwarden.operators.ensemble import percent, priority_rank

CONTEXT = {"src_ip": "source_ip", "dst_ip": "destination_ip", "src_port": "source_port",
           "dst_port": "destination_port", "protocol": "protocol"}


def _mitre(threat: Column, part: int) -> Column:
    """Constant lookup of four categories; other categories have no entries."""
    out = None
    for name, lists in K.MITRE.items():
        values = F.array(*[F.lit(v) for v in lists[part]])
        out = F.when(threat == name, values) if out is None else out.when(threat == name, values)
    return out.otherwise(F.array().cast("array<string>"))


def add_mitre(df: DataFrame, threat: str = "threat_category") -> DataFrame:
    return df.withColumns({"mitre_tactics": _mitre(F.col(threat), 0), "mitre_techniques": _mitre(F.col(threat), 1)})


def generate_alerts(scored: DataFrame, record: str = "record_id", ts: str | None = "ts",
                    include_mitre: bool = True) -> DataFrame:
    """Alerts of the scored rows that need one.

    Identifier and time come from the record, so a rerun gives the same alerts.
    """
    rows = scored.where("requires_alert")
    rows = add_mitre(rows) if include_mitre else rows.withColumns(
        {"mitre_tactics": F.array().cast("array<string>"), "mitre_techniques": F.array().cast("array<string>")})
    context = [F.col(c).alias(n) for c, n in CONTEXT.items() if c in scored.columns]
    stamp = [F.col(ts).alias("timestamp")] if ts else []
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit("alert"), F.col(record).cast("string")), 256).alias("alert_id"), *stamp,
        F.col("alert_priority").alias("priority"), "risk_level", "threat_category", "anomaly_score",
        F.col("class_confidence").alias("classification_confidence"), "combined_risk_score", "classification",
        "reasoning", "suggested_action", "mitre_tactics", "mitre_techniques", *context,
        F.lit("New").alias("status"), F.lit(None).cast("string").alias("assigned_to"),
        F.array().cast("array<string>").alias("notes"), F.col(record).cast("string").alias("raw_record_id"))


def at_least(df: DataFrame, min_priority: str, priority: str = "priority") -> DataFrame:
    """Alerts at or above a priority; an unknown name lets everything pass."""
    floor = K.PRIORITIES.index(min_priority) if min_priority in K.PRIORITIES else 5
    return df.where(priority_rank(F.col(priority)) <= floor)


def search(df: DataFrame, priority_text: str = "All", text: str = "", fields: list[str] | None = None) -> DataFrame:
    """Priority substring and case-insensitive text search."""
    if priority_text != "All":
        df = df.where(F.lower("priority").contains(priority_text.lower()))
    if text:
        hit = F.lit(False)
        for f in fields or ["classification", "source_ip", "batch_id"]:
            hit = hit | F.coalesce(F.lower(F.col(f).cast("string")).contains(text.lower()), F.lit(False))
        df = df.where(hit)
    return df


def by_urgency(df: DataFrame, *tie: str) -> DataFrame:
    """Sort by priority, then by the tie columns."""
    return df.orderBy(priority_rank(F.col("priority")), *tie)


def most_recent(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Newest ``n`` rows: a top-k per task, then one small merge."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key.

    ``min_by`` combines before the shuffle, so a hot key costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


# --------------------------------------------------------------- explanation
_THREE = [(0.7, "high"), (0.4, "moderate")]
_CONF = [(0.8, "high"), (0.6, "moderate")]


def explain(df: DataFrame, anomaly: str = "anomaly_score", confidence: str = "classification_confidence",
            label: str = "classification", priority: str = "priority") -> DataFrame:
    """Summary, interpretations and rationale in words."""
    a, c, cls = F.col(anomaly), F.col(confidence), F.col(label)
    a_word, c_word = banded(a, _THREE, "low"), banded(c, _CONF, "low")
    strength = banded(c, [(0.8, "strong"), (0.6, "moderate")], "weak")
    return df.withColumns({
        "summary": F.concat(F.initcap(a_word), F.lit(" anomaly detected with "), c_word,
                            F.lit(" confidence classification as "), cls, F.lit(".")),
        "anomaly_interpretation": banded(a, [(0.8, "Highly unusual behavior detected"),
                                             (0.6, "Moderately unusual behavior detected"),
                                             (0.4, "Slightly unusual behavior detected")],
                                         "Behavior within normal range"),
        "class_interpretation": F.concat(F.lit("Pattern shows "), strength, F.lit(" resemblance to "), cls,
                                         F.lit(" attack type")),
        "rationale": F.concat(F.initcap(a_word), F.format_string(" anomaly score (%.2f) combined with ", a), c_word,
                              F.lit(" "), cls, F.format_string(" confidence (%.2f) resulted in ", c), F.col(priority),
                              F.lit(" priority alert.")),
    })


def contributing_features(df: DataFrame, port: str | None = "dst_port", packets: str | None = "packet_count",
                          sent: str | None = "bytes_sent", top: int = 3) -> Column:
    """Array of (feature, value, reason) for the values that stand out."""
    checks = [
        (port, lambda v: (v != 0) & ~v.isin([float(p) for p in K.EXPECTED_PORTS]), "Uncommon destination port"),
        (packets, lambda v: v > K.HIGH_PACKET_COUNT, "High packet volume"),
        (sent, lambda v: v > K.HIGH_BYTES_SENT, "Large data transfer"),
    ]
    found = []
    for name, test, reason in checks:
        if name and name in df.columns:
            v = F.col(name).cast("double")
            found.append((test(v), F.struct(F.lit(name).alias("feature"), v.alias("value"), F.lit(reason).alias("reason"))))
    return F.slice(compact_list(*found), 1, top)


def explanation_notes(risk: Column, confidence: Column, tactics: Column) -> Column:
    level = F.upper(risk)
    return compact_list(
        (level == "CRITICAL", F.lit("Immediate investigation recommended")),
        (level == "HIGH", F.lit("Prompt investigation recommended")),
        (confidence < 0.6, F.lit("Classification confidence is moderate - manual verification suggested")),
        (F.size(tactics) > 0, F.concat(F.lit("Mapped to MITRE ATT&CK tactics: "), F.array_join(tactics, ", "))),
    )


def summary_text(df: DataFrame, name: str = "summary_text") -> DataFrame:
    """A readable block per alert."""
    where = lambda ip, port: F.when(F.col(ip).isNotNull(), F.concat(
        F.col(ip), F.lit(":"), F.coalesce(F.nullif(F.col(port).cast("string"), F.lit("0")), F.lit("N/A"))))
    lines = [
        F.concat(F.lit("ALERT: "), F.col("priority"), F.lit(" - "), F.col("threat_category")),
        F.concat(F.lit("ID: "), F.substring("alert_id", 1, 8), F.lit("...")),
        F.concat(F.lit("Time: "), F.col("timestamp").cast("string")),
        F.concat(F.lit("Risk Level: "), F.col("risk_level")),
        F.format_string("Risk Score: %.2f", F.col("combined_risk_score")),
        F.concat(F.lit("Classification: "), F.col("classification"), F.lit(" ("),
                 percent(F.col("classification_confidence")), F.lit(")")),
        F.format_string("Anomaly Score: %.2f", F.col("anomaly_score")),
    ]
    if "source_ip" in df.columns and "source_port" in df.columns:
        lines.append(F.concat(F.lit("Source: "), where("source_ip", "source_port")))
    if "destination_ip" in df.columns and "destination_port" in df.columns:
        lines.append(F.concat(F.lit("Destination: "), where("destination_ip", "destination_port")))
    lines += [
        F.when(F.size("reasoning") > 0, F.concat(F.lit("Reasoning: "), F.array_join("reasoning", "; "))),
        F.concat(F.lit("Action: "), F.col("suggested_action")),
        F.when(F.size("mitre_techniques") > 0, F.concat(
            F.lit("MITRE ATT&CK: "), F.array_join(F.slice("mitre_techniques", 1, 2), ", "))),
    ]
    return df.withColumn(name, F.concat_ws("\n", *lines))


