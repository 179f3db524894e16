"""Frequency-ranked category codes.

Code 0 stands for null, 1 for unseen or rare values, 2 and up for the known
values by falling frequency (ties by value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logwarden.functions.scalars import quoted

UNKNOWN, RARE, FIRST = 0, 1, 2
UNKNOWN_LABEL, RARE_LABEL = "<UNKNOWN>", "<RARE>"
MAX_CATEGORIES = 100


def fit_codes(df: DataFrame, fields: list[str], min_frequency: int = 1,
              max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Code table (field, label, code); at most ``max_categories`` rows per field.

    The top values are taken per field with a bounded top-k before they are
    numbered, so no task ranks all values of a field.
    """
    parts = []
    for f in fields:
        counts = (df.select(quoted(f).cast("string").alias("label")).where("label IS NOT NULL")
                  .groupBy("label").count().where(F.col("count") >= min_frequency))
        parts.append(counts.orderBy(F.desc("count"), "label").limit(max(max_categories - FIRST, 0))
                     .select(F.lit(f).alias("field"), "label", "count"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    ranked = W.partitionBy("field").orderBy(F.desc("count"), "label")  # at most max_categories rows per field
    return table.select("field", "label", (F.row_number().over(ranked) + (FIRST - 1)).cast("int").alias("code"))


def encode(df: DataFrame, codes: DataFrame, fields: list[str], suffix: str = "_encoded") -> DataFrame:
    """Add ``<field>_encoded``; the original column stays."""
    for f in fields:
        table = codes.where(F.col("field") == f).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        # The fitted table holds at most max_categories rows per field.
        df = df.join(F.broadcast(table), quoted(f).cast("string") == F.col("_label"), "left").withColumn(
            f + suffix, F.when(quoted(f).isNull(), UNKNOWN).otherwise(F.coalesce("_code", F.lit(RARE)))
        ).drop("_label", "_code")
    return df


def decode(df: DataFrame, codes: DataFrame, fields: list[str], suffix: str = "_encoded") -> DataFrame:
    """Set ``<field>`` from its code; unknown codes leave the column as it is."""
    for f in fields:
        table = codes.where(F.col("field") == f).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        label = F.when(F.col(f + suffix) == UNKNOWN, UNKNOWN_LABEL).when(F.col(f + suffix) == RARE, RARE_LABEL).otherwise(F.col("_label"))
        text = F.coalesce(label, quoted(f).cast("string")) if f in df.columns else label
        df = df.join(F.broadcast(table), F.col(f + suffix) == F.col("_code"), "left").withColumn(f, text).drop("_label", "_code")
    return df
