"""Training labels: mapping, distribution, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logwarden import constants as K
from logwarden.functions.scalars import lookup, quoted
from logwarden.session import cut_lineage


def normalize_training_columns(df: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Trim, lower and underscore column names, then drop identifiers and addresses."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    gone = {d.lower().replace(" ", "_") for d in (K.TRAINING_DROP_COLUMNS if drop is None else drop)}
    seen: dict[str, int] = {}
    unique = []
    for n in names:  # repeated headers get a numbered name, as CSV readers give them
        seen[n] = seen.get(n, -1) + 1
        unique.append(n if seen[n] == 0 else f"{n}.{seen[n]}")
    return df.toDF(*unique).select(*[quoted(n) for n in unique if n not in gone])


def map_labels(df: DataFrame, column: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Set ``label`` to one of the classes, 'Unknown' if the raw label is not listed.

    The table is a constant of about fifty entries, so the lookup is part of
    the projection and needs no join.
    """
    column = column or next((c for c in df.columns if c in K.LABEL_COLUMNS), None)
    if column is None:
        return df.withColumn("label", F.lit("Unknown"))
    raw = F.regexp_replace(quoted(column).cast("string"), r"^\s+|\s+$", "")
    return df.withColumn("label", lookup({**K.LABEL_CLASSES, **(extra or {})}, raw, "Unknown"))


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def benign_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") == "Benign")


def split_hash(record: Column, seed: int) -> Column:
    """A number from 0 to 2**60 - 1 by seed and identifier, which other engines can compute as well."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), record.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, record: str, label: str = "label", test_share: float = 0.2,
                     seed: int = 42, rounds: int = 2, digits: int = 12) -> DataFrame:
    """Add ``is_test``: per label exactly ``n - floor(n * (1 - share))`` rows, those of largest seeded hash.

    The hash at which a label is cut is found by refining a histogram: each round counts a label's rows by the next ``digits``
    bits of those hashes that share the cut's earlier bits, so a task sees at most ``2**digits`` counts of a label, however
    many rows that has.  What is left after the last round, one row in ``2**(rounds * digits)``, is ordered as it is.  ``record`` identifies
    rows; rows without label are left out.
    """
    hashed = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), F.col(record).alias("_id"), split_hash(F.col(record), seed).alias("_h"))
    sizes = hashed.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    # _rank rows of the bucket ``_top`` (none yet: 0) and all rows of smaller hashes are for training.
    cut = sizes.select("_label", F.lit(0).cast("long").alias("_top"), F.floor(F.col("_n") * F.lit(1.0 - test_share) + F.lit(1e-9)).alias("_rank"))
    for i in range(1, rounds + 1):
        shift = 60 - i * digits
        inside = hashed.withColumn("_b", F.shiftright("_h", shift)).join(cut, "_label").where(F.shiftright("_b", digits) == F.col("_top"))
        counts = inside.groupBy("_label", "_b").agg(F.count(F.lit(1)).alias("_c"), F.max("_rank").alias("_rank"))
        upto = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy("_label").orderBy("_b")))
        # The first bucket that reaches the rank holds the cut; a rank of 0 is cut in the first bucket, before its rows.
        found = upto.where(F.col("_upto") >= F.col("_rank")).groupBy("_label").agg(F.min(F.struct("_b", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"))).alias("f"))
        cut = cut_lineage(found.select("_label", F.col("f._b").alias("_top"), F.greatest("f._rank", F.lit(0)).alias("_rank")), "split-cut")
    last = hashed.join(cut, "_label").where(F.shiftright("_h", 60 - rounds * digits) == F.col("_top"))
    ordered = last.withColumn("_at", F.row_number().over(W.partitionBy("_label").orderBy("_h", "_id")))
    final = cut_lineage(ordered.where("_at = _rank").select("_label", F.struct("_h", "_id").alias("_last")), "split-cut")
    both = df.withColumn("_mine", F.struct(split_hash(F.col(record), seed).alias("_h"), F.col(record).alias("_id"))).join(
        cut.select("_label").join(final, "_label", "left"), F.col(label) == F.col("_label"))
    # A label without training rows has no last one.
    return both.withColumn("is_test", F.coalesce(F.col("_mine") > F.col("_last"), F.lit(True))).select(*df.columns, "is_test")
