"""The feature pipeline: extractors fitted on one frame and applied to another.

All ordered features share the key and time columns, so without a large key
they share one shuffle of the rows; profiles are aggregated on the side and
joined on the same key.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from logwarden.operators.runs import is_cold, keyed
from logwarden.operators.standardize import select_features
from logwarden.plans.extractors import Feature, FeatureConfig, State, extractor
from logwarden.session import cut_lineage

NUMBERS = ("byte", "short", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean", "decimal")


def definitions(config: FeatureConfig = FeatureConfig()) -> list[Feature]:
    """Every feature the configuration produces, in order."""
    out = [d for g in config.groups for d in extractor(g).definitions(config)]
    chosen = [d for d in out if not config.include_only or d.name in config.include_only]
    return [d for d in chosen if d.name not in config.exclude]


def fit_states(df: DataFrame, config: FeatureConfig) -> dict[str, State]:
    """What every extractor learns from ``df``; nothing is computed before a table is used."""
    if config.entity not in df.columns:
        return {g: {} for g in config.groups}
    return {g: extractor(g).fit(df, config) for g in config.groups}


def add_features(df: DataFrame, config: FeatureConfig, states: dict[str, State]) -> DataFrame:
    """``df`` with the features of all extractors, given what they learned; a feature that is no number is an error."""
    c = config
    wanted = definitions(c)
    if c.entity not in df.columns:
        # No entity, no features: all defaults.
        return df.withColumns({d.name: F.lit(d.default).cast(d.dtype) for d in wanted})
    if c.ts in df.columns:
        rows, added = keyed(df, c.entity, c.ts, c.record)
        cold = is_cold(rows, ["_key"], ["_t", c.record])
    else:
        rows, added, cold = df.withColumn("_key", F.col(c.entity).cast("string")), ["_key"], True
    for g in c.groups:
        rows = extractor(g).transform(rows, df, c, states.get(g, {}), cold)
    rows = rows.drop(*added)
    missing = {d.name: F.lit(d.default).cast(d.dtype) for d in wanted if d.name not in rows.columns}
    if missing:
        rows = rows.withColumns(missing)
    names = [d.name for d in wanted]
    kinds = dict(rows.dtypes)
    wrong = [n for n in names if not kinds[n].startswith(NUMBERS)]
    if wrong:
        raise ValueError("features must be numbers: " + ", ".join(f"{n} is {kinds[n]}" for n in wrong))
    base = df.columns if c.keep_originals else []
    return select_features(rows.select(*[f"`{n}`" for n in base], *[f"`{n}`" for n in names]), names)


def build_features(df: DataFrame, config: FeatureConfig = FeatureConfig(), baseline: DataFrame | None = None) -> DataFrame:
    """Add all features.

    ``baseline`` holds earlier records; first-time flags and z-scores are
    relative to it.  Without one the extractors are fitted on ``df`` itself, so every pair is
    known and first-time flags are 0.
    """
    states = fit_states(df if baseline is None else baseline, config)
    if baseline is None:
        for state in states.values():
            state.pop("known_pairs", None)
    return add_features(df, config, states)


class FeaturePipeline(Estimator):
    """Fits the extractors named in ``config.groups``."""

    def __init__(self, config: FeatureConfig = FeatureConfig()):
        super().__init__()
        self.config = config

    def _fit(self, dataset: DataFrame) -> FeaturePipelineModel:
        # Written once, so that every use of the model sees the same tables.
        states = {g: {n: cut_lineage(t, f"fitted-{g}-{n}") for n, t in state.items()} for g, state in fit_states(dataset, self.config).items()}
        return FeaturePipelineModel(self.config, states)


class FeaturePipelineModel(Model):
    """Fitted extractors: their configuration and their tables, both of which :meth:`save` keeps."""

    def __init__(self, config: FeatureConfig, states: dict[str, State]):
        super().__init__()
        self.config, self.states = config, states

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_features(dataset, self.config, self.states)

    def save(self, path: str) -> None:
        """One Parquet table per learned table below ``path``, and the configuration as a line of JSON, written last."""
        tables = [(g, n) for g, state in self.states.items() for n in state]
        for g, n in tables:
            self.states[g][n].write.mode("overwrite").parquet(f"{path}/{g}/{n}")
        spark = SparkSession.active()
        about = json.dumps({"config": dataclasses.asdict(self.config), "tables": tables})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> FeaturePipelineModel:
        """The stored model; extractors of your own must be registered before."""
        spark = SparkSession.active()
        about = json.loads(spark.read.text(f"{path}/metadata").first().value)
        config = FeatureConfig(**about["config"])
        states: dict[str, State] = {extractor(g).name: {} for g in config.groups}
        for g, n in about["tables"]:
            states[g][n] = spark.read.parquet(f"{path}/{g}/{n}")
        return FeaturePipelineModel(config, states)
