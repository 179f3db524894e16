"""Connected components of an edge table by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: Edges that a task of a round reads at least; fewer are not spread, as each task of an exchange leaves files of its own.
TASK_EDGES = 50_000
#: The same for rows that hold signatures or shingle sets.
TASK_SETS = 2_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def gathered(rows: DataFrame, n: int, each: int = TASK_EDGES) -> DataFrame:
    """``rows``, counted to be about ``n``, in no more partitions than have ``each`` rows."""
    return rows.coalesce(1 + n // each)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``edges``; the label is the smallest node of its component.

    Each round joins every node to the smallest of its neighbours, first towards larger
    nodes and then towards smaller ones, until each component is one star.  Rounds grow with the
    logarithm of the longest path, and use as many tasks as the edges that are left need.  A node with very many edges is aggregated before its
    shuffle and joined with its minimum only, which Spark splits if it is skewed.
    Edges with a null end, loops and repeated edges are ignored.
    """
    e = (gathered(edges, edges.count()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct().checkpoint())
    before = _state(e)
    while before[0]:
        both = gathered(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * before[0])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = gathered(small.unionByName(low.select("u", F.col("m").alias("v"))), before[0]).distinct().checkpoint()
        after = _state(e)
        if after == before:
            break
        before = after
    e = gathered(e, before[0])
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
