"""Evaluation of class predictions from one small count table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (label, prediction)."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio has no denominator."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = counts.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = counts.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    both = actual.join(guessed, "cls", "full").na.fill(0)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rated = both.withColumns({"precision": rate("tp", "predicted"), "recall": rate("tp", "support")})
    p, r = F.col("precision"), F.col("recall")
    return rated.select("cls", "precision", "recall",
                        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"), "support")


def accuracy(counts: DataFrame) -> DataFrame:
    """One row with the share of correct predictions."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return counts.agg((right / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def score_separation(df: DataFrame, score: str = "anomaly_score", label: str = "label") -> DataFrame:
    """Mean score of benign and of attack rows."""
    benign = F.col(label) == "Benign"
    return df.agg(F.avg(F.when(benign, F.col(score))).alias("benign_mean"),
                  F.avg(F.when(~benign, F.col(score))).alias("attack_mean"))
