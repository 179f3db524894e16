"""Canonical security columns over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` seen as network log records with model outputs.

    Only the columns a query uses are read from the file.
    """
    parsed = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    return parsed.select(
        F.col("event_id").alias("record_id"), "ts", F.col("user_id").cast("string").alias("src_ip"),
        F.concat(F.lit("d"), k).alias("dst_ip"), (k * 660).alias("dst_port"), "k",
        F.col("event_type").alias("action"), F.col("value").alias("bytes_total"),
        F.when(k % 3 == 0, "TCP").when(k % 3 == 1, "udp").otherwise("ICMP").alias("protocol"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("anomaly_score"),
        F.when(F.col("event_type") == "error", "Malware").when(F.col("event_type") == "signup", "Benign")
        .when(F.col("event_type") == "purchase", "Exfiltration").when(F.col("event_type") == "click", "DDoS")
        .otherwise("BruteForce").alias("classification"),
        (k / F.lit(100.0)).alias("class_confidence"))
