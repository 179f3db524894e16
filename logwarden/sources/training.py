"""Labelled flow data for model training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logwarden.operators.labels import map_labels, normalize_training_columns
from logwarden.sources.readers import read_csv


def load_dataset(spark: SparkSession, path: str, max_rows_per_file: int | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """All CSV files below ``path``: columns matched by name, names normalized, labels mapped.

    ``max_rows_per_file`` takes the first rows of each file, a bound on what a model is trained with.
    """
    raw = read_csv(spark, path, delimiter=",", multiline=False, pattern="*.csv").drop("timestamp", "source_format")
    if max_rows_per_file is not None:
        # Ids grow along a file; Spark keeps the first rows of each piece before it shuffles.
        first = F.row_number().over(Window.partitionBy("source_file").orderBy("_at"))
        raw = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("_n", first).where(F.col("_n") <= max_rows_per_file).drop("_at", "_n")
    return map_labels(normalize_training_columns(raw.drop("source_file")), extra=labels)
