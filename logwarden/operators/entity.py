"""Per-entity statistics.

Profiles are computed by partial aggregation and joined back to the rows; Spark
broadcasts a small profile and splits a skewed partition of a large join.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logwarden import constants as K
from logwarden.functions.scalars import flag, safe_divide
from logwarden.session import cut_lineage

#: Values that a task sorts for exact percentiles, about.
TASK_VALUES = 500_000
#: Large entities (with their brackets) that are broadcast.
BROADCAST_ENTITIES = 50_000


def _entropy(n: Column, n_log_n: Column) -> Column:
    """Bits, from the sums of counts and of count * log2(count)."""
    return F.when(n > 0, F.greatest(F.log2(n) - n_log_n / n, F.lit(0.0))).otherwise(F.lit(0.0))


def numeric_profile(df: DataFrame, entity: str, fields: list[str], prefix: str = "stat") -> DataFrame:
    """Row count, and mean, population deviation, minimum and maximum per field (0 if all null)."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_record_count")]
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    for f in fields:
        x = F.col(f)
        aggs += [zero(F.avg(x)).alias(f"{prefix}_{f}_mean"), zero(F.stddev_pop(x)).alias(f"{prefix}_{f}_std"),
                 zero(F.min(x)).alias(f"{prefix}_{f}_min"), zero(F.max(x)).alias(f"{prefix}_{f}_max")]
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*aggs)


def percentile_profile(df: DataFrame, entity: str, field: str, percents: list[int] | None = None,
                       prefix: str = "stat", approximate: bool = False) -> DataFrame:
    """Percentiles of one field per entity, see :func:`percentile_profiles`."""
    return percentile_profiles(df, entity, [field], percents, prefix, approximate)


def percentile_profiles(df: DataFrame, entity: str, fields: list[str], percents: list[int] | None = None, prefix: str = "stat",
                        approximate: bool = False, accuracy: int = 5000, whole: int = 10_000) -> DataFrame:
    """Percentiles of all fields per entity with linear interpolation; 0 where a field has no values.

    Exact by default, in at most four scans whatever the number of fields and the size of entities.  Values are counted first.  A field of an entity with at most ``whole`` values is sorted whole, in
    tasks of about :data:`TASK_VALUES` values.  A larger one gets a mergeable quantile sketch, which brackets every wanted rank by twice
    four times the sketch's error; then its values are counted where they lie: those inside a bracket one by one, those between two
    brackets together.  So it sends about ``8 * n * percents / accuracy`` of its n values on, and its rows are
    not dealt by entity.  Should a rank fall outside its bracket the job fails; no wrong value is returned.
    ``approximate`` returns the sketch's own values.
    """
    percents = K.PERCENTILES if percents is None else percents
    shares = [p / 100.0 for p in percents]
    inner = [f"_v{i}" for i in range(len(fields))]
    rows = df.where(F.col(entity).isNotNull()).select(entity, *[F.col(f).cast("double").alias(v) for f, v in zip(fields, inner)])
    names = [[f"{prefix}_{f}_p{p}" for p in percents] for f in fields]
    if approximate:
        sketch = rows.groupBy(entity).agg(*[F.percentile_approx(v, shares, 10000).alias(v) for v in inner])
        return sketch.select(entity, *[F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)).alias(n) for v, of in zip(inner, names) for i, n in enumerate(of)])
    sizes = cut_lineage(rows.groupBy(entity).agg(*[F.count(v).alias(f"{v}_n") for v in inner]), "percentile-sizes")
    is_large = reduce(or_, [F.col(f"{v}_n") > whole for v in inner])
    in_small = sum((F.when(F.col(f"{v}_n") <= whole, F.col(f"{v}_n")).otherwise(0) for v in inner), F.lit(0))
    n_large, n_small = sizes.agg(F.count_if(is_large), F.coalesce(F.sum(in_small), F.lit(0))).first()
    large = sizes.where(is_large).select(F.col(entity).alias("_of"), *[(F.col(f"{v}_n") > whole).alias(f"{v}_large") for v in inner])
    large = F.broadcast(large) if n_large <= BROADCAST_ENTITIES else large
    out = sizes.select(entity)
    if n_small:
        small = rows
        if n_large:
            small = rows.join(large, F.col(entity) == F.col("_of"), "left").select(
                entity, *[F.when(~F.coalesce(f"{v}_large", F.lit(False)), F.col(v)).alias(v) for v in inner])
        out = out.join(_sorted_percentiles(small.where(F.coalesce(*inner).isNotNull()), entity, inner, shares, names, 1 + n_small // TASK_VALUES), entity, "left")
    if n_large:
        out = out.join(_counted_percentiles(rows, large, n_large, entity, inner, shares, names, accuracy), entity, "left")
    held = [*(["_small"] if n_small else []), *(["_large"] if n_large else [])]
    return out.select(entity, *[F.coalesce(*[F.col(f"{h}_{n}") for h in held], F.lit(0.0)).alias(n) for of in names for n in of])


def _between(lo: Column, hi: Column, at: Column) -> Column:
    return lo + (hi - lo) * at


def _sorted_percentiles(rows: DataFrame, entity: str, inner: list[str], shares: list[float], names: list[list[str]], parts: int) -> DataFrame:
    """Percentiles by sorting the values of each entity, which are few, in ``parts`` tasks; columns begin with ``_small_``."""
    lists = rows.repartition(parts, entity).groupBy(entity).agg(*[F.sort_array(F.collect_list(v)).alias(v) for v in inner])
    found = []
    for v, of in zip(inner, names):
        for s, name in zip(shares, of):
            position = F.lit(s) * (F.size(v) - 1)
            lo, hi = (F.when(F.size(v) > 0, F.get(v, end(position).cast("int"))) + F.lit(0.0) for end in (F.floor, F.ceil))
            found.append(_between(lo, hi, position - F.floor(position)).alias(f"_small_{name}"))
    return lists.select(entity, *found)


def _counted_percentiles(rows: DataFrame, large: DataFrame, n_large: int, entity: str, inner: list[str], shares: list[float],
                         names: list[list[str]], accuracy: int) -> DataFrame:
    """Percentiles of the fields marked in ``large`` by counting values between brackets; columns begin with ``_large_``."""
    reach = 4.0 / accuracy
    ends = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-reach, reach)]
    marked = rows.join(large, F.col(entity) == F.col("_of")).select(entity, *[F.when(F.col(f"{v}_large"), F.col(v)).alias(v) for v in inner])
    brackets = marked.groupBy(F.col(entity).alias("_of")).agg(*[F.percentile_approx(v, ends, accuracy).alias(f"{v}_q") for v in inner])
    brackets = cut_lineage(brackets, "percentile-brackets")
    brackets = F.broadcast(brackets) if n_large <= BROADCAST_ENTITIES else brackets

    def place(i: int, v: str):
        """The value itself, or between brackets the end of the bracket below; ``between`` sorts those after the end itself."""
        low, high = ([F.get(f"{v}_q", F.lit(2 * k + e)) for k in range(len(shares))] for e in (0, 1))
        kept = F.lit(False)
        below = F.lit(float("-inf"))
        for a, b in zip(low, high):
            kept = kept | F.col(v).between(a, b)
            below = F.greatest(below, F.when(F.col(v) > b, b))
        is_value = F.col(v).isNotNull() & F.col(f"{v}_q").isNotNull()
        return F.struct(F.lit(i).alias("field"), F.when(kept, F.col(v)).otherwise(below).alias("at"), (~kept).alias("between"), is_value.alias("is_value"))

    each = F.explode(F.array(*[place(i, v) for i, v in enumerate(inner)]))
    placed = rows.join(brackets, F.col(entity) == F.col("_of")).select(entity, each.alias("p")).where("p.is_value")
    counts = placed.groupBy(entity, "p.field", "p.at", "p.between").agg(F.count(F.lit(1)).alias("n"))
    mine = W.partitionBy(entity, "field")
    ranked = counts.withColumns({"upto": F.sum("n").over(mine.orderBy("at", "between")), "all": F.sum("n").over(mine)})
    picks = []
    for i, of in enumerate(names):
        for s, name in zip(shares, of):
            position = F.lit(s) * (F.col("all") - 1)
            for end, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
                holds = (F.col("field") == i) & (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
                value = F.when(F.col("between"), F.raise_error(F.lit("a percentile lies outside its bracket"))).otherwise(F.col("at"))
                picks.append(F.max(F.when(holds, value)).alias(f"{name}_{end}"))
            picks.append(F.max(F.when(F.col("field") == i, position - F.floor(position))).alias(f"{name}_at"))
    found = ranked.groupBy(entity).agg(*picks)
    return found.select(entity, *[_between(F.col(f"{n}_lo"), F.col(f"{n}_hi"), F.col(f"{n}_at")).alias(f"_large_{n}") for of in names for n in of])


def category_profile(df: DataFrame, entity: str, fields: list[str], prefix: str = "stat") -> DataFrame:
    """Distinct values and Shannon entropy (bits) per field.

    All fields share one pass: values are counted per (entity, field, value),
    which combines on the map side, then folded per entity.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).cast("string").alias("value"))
                                for i, f in enumerate(fields)]))
    counts = (df.where(F.col(entity).isNotNull()).select(entity, pairs.alias("p"))
              .select(entity, "p.*").groupBy(entity, "field", "value").agg(F.count(F.lit(1)).alias("n")))
    aggs = []
    for i, f in enumerate(fields):
        mine = (F.col("field") == i) & F.col("value").isNotNull()
        n = F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0))
        n_log_n = F.sum(F.when(mine, F.col("n") * F.log2("n")))
        aggs += [F.count(F.when(mine, 1)).alias(f"{prefix}_{f}_unique"),
                 _entropy(n, n_log_n).alias(f"{prefix}_{f}_entropy")]
    return counts.groupBy(entity).agg(*aggs)


def network_profile(df: DataFrame, entity: str, dst: str, port: str, size: str, prefix: str = "net") -> DataFrame:
    """Connection count, distinct peers and ports, port entropy, fan-out, scanner flag, bytes."""
    totals = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count(F.lit(1)).alias(f"{prefix}_conn_count"),
        (F.coalesce(F.sum(size), F.lit(0)).cast("double") / F.count(F.lit(1))).alias(f"{prefix}_bytes_per_conn"))
    kinds = category_profile(df, entity, [dst, port], prefix="_c")
    fanout = safe_divide(F.col(f"{prefix}_unique_dst_ips").cast("double"), F.col(f"{prefix}_conn_count"))
    return totals.join(kinds, entity).select(
        entity, f"{prefix}_conn_count", f"{prefix}_bytes_per_conn",
        F.col(f"_c_{dst}_unique").alias(f"{prefix}_unique_dst_ips"),
        F.col(f"_c_{port}_unique").alias(f"{prefix}_unique_dst_ports"),
        F.col(f"_c_{port}_entropy").alias(f"{prefix}_dst_port_entropy"),
    ).withColumn(f"{prefix}_fanout_ratio", fanout).withColumn(
        f"{prefix}_is_scanner_like",
        flag((F.col(f"{prefix}_fanout_ratio") > K.SCANNER_FANOUT)
             & (F.col(f"{prefix}_unique_dst_ips") > K.SCANNER_MIN_DESTINATIONS)))


def connection_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct (src, dst) pairs without nulls and empty names."""
    return (df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
            .where("src <> '' AND dst <> ''").distinct())


def out_degree(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Number of distinct peers per source."""
    return connection_edges(df, src, dst).groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def port_distribution(df: DataFrame, port: str) -> DataFrame:
    """Events per port, ports that are no integers left out."""
    number = F.col(port).try_cast("long")
    return df.select(number.alias("port")).where("port IS NOT NULL").groupBy("port").agg(
        F.count(F.lit(1)).alias("events"))


def global_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per field: mean, sample deviation (0 for one value), minimum, maximum."""
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("p")).select("p.*")
    return rows.where("v IS NOT NULL AND NOT isnan(v)").groupBy("field").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))


def entity_means(df: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """Baseline means per entity."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        *[F.avg(f).alias(f"{f}_mean") for f in fields])


def attach(df: DataFrame, profile: DataFrame, entity: str) -> DataFrame:
    """Join a profile to its rows; rows without entity get zeros."""
    added = [c for c in profile.columns if c != entity]
    return df.join(profile, entity, "left").na.fill(0, added)
