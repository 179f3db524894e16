"""Ordered, switchable preprocessing steps over ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from logwarden.functions.scalars import quoted
from logwarden.operators import encode, missing, standardize
from logwarden.session import cut_lineage

Counts = dict[str, int]


@dataclass(frozen=True)
class Counters:
    """What a step counts: aggregates over its input and its output, and the numbers made of both.

    All aggregates of a frame are taken in one pass of the job that uses the result, and Spark adds them up over its tasks.
    """

    before: Callable[[DataFrame], dict[str, Column]]
    after: Callable[[DataFrame], dict[str, Column]]
    finish: Callable[[Counts, Counts], Counts]


@dataclass(frozen=True)
class Step:
    """A named step; ``apply`` is any ``DataFrame -> DataFrame`` function, ``counters`` what it counts besides rows.

    ``runs_jobs`` tells that ``apply`` reads its input while it plans.  Where steps are counted, such a step gets its input
    as a written table, so that what the steps before it count is what was written.
    """

    name: str
    apply: Callable[[DataFrame], DataFrame]
    enabled: bool = True
    counters: Counters | None = None
    runs_jobs: bool = False


@dataclass
class Preprocessing:
    """Runs its steps in order and keeps rows whose required fields are set.

    With ``observe`` each step counts while the job runs; read the
    numbers with :meth:`stats` after an action that reads all rows.
    """

    steps: list[Step]
    required: list[str] = field(default_factory=lambda: ["timestamp_normalized"])
    observe: bool = False
    observations: dict[str, Observation] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            if not step.enabled:
                continue
            watch = step.counters if self.observe else None
            if watch:
                df = self._watched(df, f"{step.name} input", watch.before(df))
            if self.observe and step.runs_jobs:
                df = cut_lineage(df, "preprocess")
            df = df.transform(step.apply)
            if self.observe:
                stamped = F.count("timestamp_normalized") if "timestamp_normalized" in df.columns else F.lit(None)
                df = self._watched(df, step.name, {"with_time": stamped, **(watch.after(df) if watch else {})})
        present = [c for c in self.required if c in df.columns]
        if len(present) < len(self.required):
            return df.where(F.lit(False))
        return missing.required_output(df, present)

    def _watched(self, df: DataFrame, name: str, counts: dict[str, Column]) -> DataFrame:
        self.observations[name] = Observation(name)
        return df.observe(self.observations[name], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])

    def stats(self) -> dict[str, dict]:
        """Per step: rows and with_time of its output and, where it has counters, their numbers."""
        out = {}
        for step in self.steps:
            if step.name in self.observations:
                got = self.observations[step.name].get
                out[step.name] = {n: got[n] for n in ("rows", "with_time")}
                if step.counters:
                    out[step.name] |= step.counters.finish(self.observations[f"{step.name} input"].get, got)
        return out


def timestamp_counters(fields: list[str] | None = None) -> Counters:
    """total_records, normalized, parse_errors and no_timestamp."""
    def before(df: DataFrame) -> dict[str, Column]:
        return {"filled": F.count(standardize.timestamp_source(df, fields))}

    def after(df: DataFrame) -> dict[str, Column]:
        made = quoted("timestamp_normalized") if "timestamp_normalized" in df.columns else F.lit(None).cast("string")
        return {"made": F.count(F.nullif(made, F.lit("")))}

    return Counters(before, after, lambda a, b: {"total_records": a["rows"], "normalized": b["made"], "parse_errors": a["filled"] - b["made"],
                                                 "no_timestamp": a["rows"] - a["filled"]})


def field_counters(**options) -> Counters:
    """total_records, and values of fields that were renamed (fields_mapped) or left out (fields_dropped)."""
    def before(df: DataFrame) -> dict[str, Column]:
        plan = standardize.field_plan(df.columns, **options)
        target = {source: name for name, sources in plan.items() for source in sources}
        total = lambda names: sum((F.count(quoted(n)) for n in names), F.lit(0))
        return {"mapped": total([c for c in df.columns if target.get(c, c) != c]), "dropped": total([c for c in df.columns if c not in target])}

    return Counters(before, lambda df: {}, lambda a, b: {"total_records": a["rows"], "fields_mapped": a["mapped"], "fields_dropped": a["dropped"]})


def missing_counters(policy: missing.MissingPolicy) -> Counters:
    """total_records, dropped_records, filled_values and flagged_missing, the last two for each field as well."""
    defaults = {r.field: r.default for r in policy.rules}

    def filled_fields(df: DataFrame) -> dict[str, str]:
        return {c: s for c, s in missing.strategies(df, policy).items()
                if s not in ("drop", "flag_missing") and (s != "fill_default" or defaults.get(c) is not None)}

    def before(df: DataFrame) -> dict[str, Column]:
        keep = missing.survives(df, policy)
        lacks = lambda c: missing.missing(df, c, policy.tokens) if c in df.columns else F.lit(True)
        return {f"lacking {c}": F.count_if(keep & lacks(c)) for c in filled_fields(df)}

    def after(df: DataFrame) -> dict[str, Column]:
        # A constant fills whatever was missing; a fitted or earlier value need not exist.
        still = {f"lacking {c}": F.count_if(missing.missing(df, c, policy.tokens)) for c, s in filled_fields(df).items()
                 if s not in ("fill_zero", "fill_default") and c in df.columns}
        return still | {f"flagged {c}": F.count(quoted(f"{c}_missing")) for c in missing.strategies(df, policy) if f"{c}_missing" in df.columns}

    def finish(a: Counts, b: Counts) -> Counts:
        filled = {c.removeprefix("lacking "): n - b.get(c, 0) for c, n in a.items() if c.startswith("lacking ")}
        flagged = {c.removeprefix("flagged "): n for c, n in b.items() if c.startswith("flagged ")}
        return {"total_records": a["rows"], "dropped_records": a["rows"] - b["rows"], "filled_values": sum(filled.values()),
                "flagged_missing": sum(flagged.values()), **{f"filled_values.{c}": n for c, n in filled.items() if n},
                **{f"flagged_missing.{c}": n for c, n in flagged.items() if n}}

    return Counters(before, after, finish)


def code_counters(categories: list[str]) -> Counters:
    """total_records, fields_encoded, unknown_values and rare_values."""
    def after(df: DataFrame) -> dict[str, Column]:
        codes = [quoted(f"{c}_encoded") for c in categories]
        total = lambda counts: sum(counts, F.lit(0))
        return {"encoded": total(F.count(c) for c in codes), "unknown": total(F.count_if(c == encode.UNKNOWN) for c in codes),
                "rare": total(F.count_if(c == encode.RARE) for c in codes)}

    return Counters(lambda df: {}, after, lambda a, b: {"total_records": a["rows"], "fields_encoded": b["encoded"],
                                                        "unknown_values": b["unknown"], "rare_values": b["rare"]})


def default_steps(policy: missing.MissingPolicy | None = None, categories: list[str] | None = None,
                  codes: DataFrame | None = None, year: int | None = None) -> list[Step]:
    """Timestamps, field names, missing values, category codes.

    Codes are added beside the original columns and only for ``categories``.
    """
    policy = policy or missing.MissingPolicy()
    ordered = {"forward_fill", "fill_median"} & {policy.default_strategy, *[r.strategy for r in policy.rules]}
    steps = [Step("timestamp_normalizer", lambda df: standardize.normalize_timestamps(df, year=year), counters=timestamp_counters()),
             Step("field_standardizer", standardize.standardize_fields, counters=field_counters()),
             Step("missing_values", lambda df: missing.handle_missing(df, policy), counters=missing_counters(policy), runs_jobs=bool(ordered))]
    if categories:
        def encoded(df: DataFrame) -> DataFrame:
            table = encode.fit_codes(df, categories) if codes is None else codes
            return encode.encode(df, table, categories)
        steps.append(Step("categorical_encoder", encoded, counters=code_counters(categories)))
    return steps
