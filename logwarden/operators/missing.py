"""Missing-value handling."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden import constants as K
from logwarden.functions.scalars import is_missing, null_if_missing, quoted
from logwarden.operators.runs import Measure, make_runs, running

@dataclass(frozen=True)
class FieldRule:
    field: str
    strategy: str = "drop"
    default: Any = None
    required: bool = True


@dataclass(frozen=True)
class MissingPolicy:
    """What to do per field; ``order`` is needed for forward fill."""

    default_strategy: str = "drop"
    rules: list[FieldRule] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=lambda: list(K.MISSING_TOKENS))
    order: list[str] = field(default_factory=list)
    within: list[str] = field(default_factory=list)


def missing(df: DataFrame, name: str, tokens: list[str] | None = None) -> Column:
    return is_missing(quoted(name), df.schema[name].dataType, tokens)


def drop_required(df: DataFrame, fields: list[str], tokens: list[str] | None = None) -> DataFrame:
    """Keep rows where every required field has a value."""
    for name in fields:
        df = df.where(~missing(df, name, tokens)) if name in df.columns else df.where(F.lit(False))
    return df


def required_output(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keep rows whose fields are neither null nor the empty string."""
    for name in fields:
        c = quoted(name)
        keep = c.isNotNull()
        if isinstance(df.schema[name].dataType, T.StringType):
            keep = keep & (c != "")
        df = df.where(keep)
    return df


def fill_constant(df: DataFrame, name: str, value: Any) -> DataFrame:
    return df.withColumn(name, F.coalesce(null_if_missing(df, name), F.lit(value).cast(df.schema[name].dataType)))


def flag_missing(df: DataFrame, name: str) -> DataFrame:
    """Add ``<name>_missing``: true where missing, else null."""
    return df.withColumn(f"{name}_missing", F.when(missing(df, name), True))


def fit_fills(df: DataFrame, wanted: dict[str, str], tokens: list[str] | None = None) -> DataFrame:
    """Fill values as one row with a column per field: mean, median or mode of the non-missing values.

    Means need one aggregate.  A median is the exact middle of the whole
    column and is found by rank over counted values.  The mode is the largest
    count, ties going to the smallest value.
    """
    means, scalars = [], []
    for n, s in wanted.items():
        value = null_if_missing(df, n, tokens)
        if s == "fill_mean":
            means.append(F.avg(value.try_cast("double")).alias(n))
        elif s == "fill_median":
            scalars.append(_median(df.select(value.try_cast("double").alias("_v"))).scalar().alias(n))
        elif s == "fill_mode":
            counts = df.select(value.alias("_v")).where("_v IS NOT NULL").groupBy("_v").count()
            best = counts.orderBy(F.desc("count"), F.asc("_v")).limit(1)
            scalars.append(best.select("_v").scalar().alias(n))
        else:
            raise ValueError(s)
    # With no mean the single row comes from an empty aggregate.
    return df.agg(*(means or [F.lit(1).alias("_one")])).select(
        *[F.col(n) for n, s in wanted.items() if s == "fill_mean"], *scalars).select(*wanted)


def _median(values: DataFrame) -> DataFrame:
    weights = values.where("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    runs = running(make_runs(weights, ["_all"], ["_v"]), Measure("_upto", "sum", F.col("_n")))
    placed = runs.finish().withColumn("_total", weights.agg(F.sum("_n")).scalar())
    mid_lo, mid_hi = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    return placed.agg(((at(mid_lo) + at(mid_hi)) / 2).alias("median"))


def apply_fills(df: DataFrame, fills: DataFrame, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Fill missing values from the one-row table of fitted values."""
    filled = {}
    for n in fills.columns:
        value, kind = fills.select(quoted(n)).scalar(), df.schema[n].dataType
        if (defaults or {}).get(n) is not None:
            value = F.coalesce(value, F.lit(defaults[n]))
        filled[n] = F.coalesce(null_if_missing(df, n), value.cast(kind))
    return df.withColumns(filled)


def forward_fill(df: DataFrame, name: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Last non-missing value in order, over the whole input or per ``within`` key."""
    keyed = df.withColumn("_ff", null_if_missing(df, name))
    by = within or ["_all"]
    if not within:
        keyed = keyed.withColumn("_all", F.lit(0))
    runs = running(make_runs(keyed, by, order), Measure("_last", "last", F.col("_ff")))
    return runs.finish().withColumn(name, F.coalesce(F.col("_ff"), F.col("_last"), quoted(name))).select(*df.columns)


def strategies(df: DataFrame, policy: MissingPolicy) -> dict[str, str]:
    """Strategy of every column, and of every field with a rule, which ``df`` may lack."""
    rules = {r.field: r for r in policy.rules}
    return {c: rules[c].strategy if c in rules else "drop" if c in policy.required else policy.default_strategy
            for c in [*df.columns, *[f for f in rules if f not in df.columns]]}


def survives(df: DataFrame, policy: MissingPolicy) -> Column:
    """Whether a row has all fields that it may not lack."""
    needed = dict.fromkeys([*policy.required, *[r.field for r in policy.rules if r.strategy == "drop" and r.required]])
    keep = F.lit(True)
    for c in needed:
        keep = keep & (~missing(df, c, policy.tokens) if c in df.columns else F.lit(False))
    return keep


def handle_missing(df: DataFrame, policy: MissingPolicy, fit_on: DataFrame | None = None) -> DataFrame:
    """Apply a policy to every column."""
    rules = {r.field: r for r in policy.rules}
    strategy = strategies(df, policy)
    df = df.where(survives(df, policy))
    for c in strategy:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    fitted = {c: s for c, s in strategy.items() if s in ("fill_mean", "fill_median", "fill_mode")}
    if fitted:
        defaults = {c: rules[c].default for c in fitted if c in rules and rules[c].default is not None}
        df = apply_fills(df, fit_fills(df if fit_on is None else fit_on, fitted, policy.tokens), defaults)
    for c, s in strategy.items():
        if s == "fill_zero":
            df = fill_constant(df, c, 0)
        elif s == "fill_default" and c in rules and rules[c].default is not None:
            df = fill_constant(df, c, rules[c].default)
        elif s == "flag_missing":
            df = flag_missing(df, c)
        elif s == "forward_fill":
            if not policy.order:
                raise ValueError("forward_fill needs policy.order")
            df = forward_fill(df, c, policy.order, policy.within)
    return df
