"""Mixing sources to target weights by entropy balancing (operator 12), in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from logwarden.llm.common import BROADCAST_ROWS, WORD, small_or_shuffled
from logwarden.session import cut_lineage


@dataclass(frozen=True)
class Mix:
    """Sources in code-point order weigh ``weights``, repeating, and share ``share`` of all sizes; none gets more than ``most`` times its own.

    ``rows_per_cell`` is about the number of documents that are numbered in one task.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    tolerance: float = 1e-7
    rounds: int = 200
    rows_per_cell: int = 4096


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, text_key, c) per distinct id, source and text: its number of words (null: 0) and of rows."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_key"))
    return rows.groupBy("doc_id", "source", "size", "text_key").agg(F.count("*").alias("c"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, their number in code-point order from 0, null last.

    Spark orders ranges of sources apart and the rows before a range are added up from one count per range, so no task holds all sources.
    """
    by_name = F.col("source").asc_nulls_last()
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(sources.repartitionByRange(parts, by_name).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1
    # As many rows as there are shuffle partitions.
    placed = ranged.withColumn("inside", inside).join(F.broadcast(before), "part")
    return placed.withColumn("place", (F.col("inside") + F.col("before")).cast("long")).drop("part", "inside", "before")


def targets(cells: DataFrame, p: Mix = Mix()) -> DataFrame:
    """(source, rows, source_size, target) from cells (source, size, n).

    ``level`` is the target of a source of weight 1 that is not stopped.  A round shares what the stopped
    sources leave among the others by weight; more may then stop, and the last round is the one that stops no further.
    """
    totals = cells.groupBy("source").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    held = cut_lineage(numbered(totals).withColumn("weight", F.get(weights, F.pmod("place", F.lit(len(p.weights))).cast("int"))), "mix-sources")
    top = p.most * F.col("source_size").cast("double")
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * level > top
        now = held.agg(F.count_if(over).alias("stopped"), F.sum(F.when(~over, F.col("weight"))).alias("weight"),
                       (F.sum("source_size") * p.share - F.coalesce(F.sum(F.when(over, top)), F.lit(0.0))).alias("left")).first()
        if now.stopped == stopped or not now.weight:
            break
        stopped, level = now.stopped, now.left / now.weight
    return held.select("source", "rows", "source_size", F.least(top, F.col("weight") * level).alias("target"))


def balanced(cells: DataFrame, wanted: DataFrame, p: Mix = Mix()) -> DataFrame:
    """``wanted`` with ``tilt`` per source, so that the sum of n * size * rate is the target; the odds of rate / most are exp(tilt * size).

    Of all document rates from 0 to ``most`` that take the target's words these have the largest entropy relative to
    taking each as likely as not.  The dual has one number per source and is convex: the words taken rise with the tilt.  Newton's iteration
    runs on their log-odds, which are a straight line if all sizes are equal; a step that would leave the
    interval known to hold the solution goes to its middle instead.  Each round is one aggregation of the cells in Spark.
    A source that takes ``most`` times its size has no finite tilt and gets null, as one without words does.
    """
    # Sizes are counted in the source's mean, which keeps the tilt near 1.
    state = cut_lineage(wanted.selectExpr("*", f"if(source_size > 0 and target < {p.most} * source_size, 0D, null) as tilt", "cast(null as double) as low", "cast(null as double) as high"), "mix-tilts")
    few = state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda table: table)
    same = F.expr("source <=> of")
    for _ in range(p.rounds):
        of = state.where("tilt is not null").selectExpr("source as of", "source_size / rows as unit", "tilt")
        words = cells.join(side(of), same).selectExpr("of", "size / unit as c", "n * size / unit as w", "1 / (1 + exp(-tilt * size / unit)) as r")
        sums = words.groupBy("of").agg(F.expr("sum(w * r) as got"), F.expr("sum(w * (1 - r)) as rest"), F.expr("sum(w * c * r * (1 - r)) as slope"))
        met = state.join(side(sums), same, "left").selectExpr(*wanted.columns, "tilt", "got", "rest", "slope", f"try_divide(target, {p.most} * source_size / rows) as want", "low", "high")
        held = met.selectExpr("* except (low, high)", "if(got < want, tilt, low) as low", "if(got > want, tilt, high) as high",
                              "tilt + (ln(try_divide(want, got + rest - want)) - ln(try_divide(got, rest))) * try_divide(got * rest, (got + rest) * slope) as next")
        moved = held.selectExpr(*wanted.columns, "coalesce(if(coalesce(next > low, true) and coalesce(next < high, true), next, null), (low + high) / 2, tilt) as tilt",
                                "low", "high", "abs(try_divide(got, want) - 1) as miss")
        written = cut_lineage(moved, "mix-tilts")
        state = written.drop("miss")
        if (written.agg(F.max("miss")).first()[0] or 0) <= p.tolerance:
            break
    return state.drop("low", "high")


def rates(cells: DataFrame, wanted: DataFrame, p: Mix = Mix()) -> DataFrame:
    """Cells with their rate, and ``start``, the copies expected of the source's smaller documents."""
    of = balanced(cells, wanted, p).withColumnRenamed("source", "of")
    joined = cells.join(small_or_shuffled(of), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    by_tilt = p.most / (1 + F.exp(-F.col("tilt") * F.try_divide("size", F.col("source_size") / F.col("rows"))))
    rate = F.when(F.col("tilt").isNotNull(), by_tilt).when(F.col("source_size") > 0, F.lit(float(p.most))).otherwise(F.lit(1.0))
    # One row per source and size, so a task holds at most as many as there are sizes.
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = joined.withColumn("rate", rate)
    return rated.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)))


def decided(docs: DataFrame, p: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per distinct id, source and text: doc_id, source, text_key, size, source_size, target, rate, c (rows), total (copies of all of them).

    Rates become copies by systematic rounding: documents of a source stand by size and then by hash on a line of their rates, and
    each whole number on it is a copy.  Sums over documents up to any size are then less than one copy
    from what is expected, so a source misses its target by about its longest document.  Cells of more than ``rows_per_cell`` documents are split by
    hash into lines of their own.  Nothing is random, so reruns agree.
    """
    held = cut_lineage(sized(docs, text, key, source), "mix-rows")
    cells = cut_lineage(held.groupBy("source", "size").agg(F.sum("c").alias("n"), F.count("*").alias("docs")), "mix-cells")
    rated = cut_lineage(rates(cells, targets(cells, p), p).select(
        F.col("source").alias("of"), F.col("size").alias("of_size"), "source_size", "target", "rate", "start",
        F.ceil(F.col("docs") / p.rows_per_cell).alias("lines")), "mix-rates")
    joined = held.join(small_or_shuffled(rated), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))).drop("of", "of_size")
    lined = joined.withColumn("hash", F.xxhash64("doc_id", "text_key")).withColumn("line", F.pmod("hash", "lines"))
    own = F.pmod(F.xxhash64("size", "line", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    offset = F.when(F.col("lines") == 1, F.col("start") - F.floor("start")).otherwise(own)
    upto = F.sum("c").over(Window.partitionBy("source", "size", "line").orderBy("hash", "doc_id", "text_key"))
    at = lambda c: F.floor(F.col("offset") + F.col("rate") * c)
    total = F.greatest(F.lit(0), F.least(p.most * F.col("c"), at(F.col("upto")) - at(F.col("upto") - F.col("c"))))
    return lined.withColumns({"upto": upto, "offset": offset}).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "rate", "c", total.cast("long").alias("total"))


def mix(docs: DataFrame, p: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken (copies * size).

    A null or empty text has size 0 and takes nothing.  A null source is a source of its own, the last.  Rows equal in id, source
    and text share their copies as evenly as whole copies can be.  An empty table gives no rows.  Other columns are not read.
    """
    taken = cut_lineage(decided(docs, p, text, key, source), "mix-decided")
    largest = taken.agg(F.max("c")).first()[0] or 0
    if largest > p.rows_per_cell:
        # Rows of many equal ones are made in chunks, which are dealt out.
        taken = (taken.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(p.rows_per_cell))))
                 .repartition("doc_id", "text_key", "from"))
    else:
        taken = taken.withColumn("from", F.lit(0))
    each = F.explode(F.sequence("from", F.least(F.col("c"), F.col("from") + p.rows_per_cell) - 1))
    copies = F.expr("cast(total * (j + 1) div c - total * j div c as int)")
    return taken.withColumn("j", each).withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, p: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as it is taken; of rows equal in id, source and text one stands for all."""
    total = decided(docs, p, text, key, source).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), F.col("total").alias("__total"))
    named = docs.withColumn("__text", F.xxhash64(text)).dropDuplicates([key, source, "__text"])
    same = F.col(key).eqNullSafe(F.col("__id")) & F.col(source).eqNullSafe(F.col("__source")) & (F.col("__text") == F.col("__key"))
    kept = named.join(total.where("__total > 0"), same)
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__total")))).select(*docs.columns)
