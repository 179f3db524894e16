"""End to end: records -> features -> models -> ensemble -> cooldown -> alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from logwarden import constants as K
from logwarden.models.isolation_forest import IsolationForest, IsolationForestModel
from logwarden.models.random_forest import classify, fit_random_forest
from logwarden.operators import alerts, cooldown, ensemble, labels
from logwarden.plans.canonical import canonical_events
from logwarden.plans.features import FeatureConfig, build_features, definitions
from logwarden.session import cut_lineage


@dataclass(frozen=True)
class Models:
    isolation_forest: IsolationForestModel | None = None
    random_forest: PipelineModel | None = None

    def save(self, path: str) -> None:
        if self.isolation_forest is not None:
            self.isolation_forest.write().overwrite().save(f"{path}/isolation_forest")
        if self.random_forest is not None:
            self.random_forest.write().overwrite().save(f"{path}/random_forest")

    @staticmethod
    def load(path: str) -> Models:
        return Models(IsolationForestModel.load(f"{path}/isolation_forest"), PipelineModel.load(f"{path}/random_forest"))


@dataclass(frozen=True)
class AnalysisConfig:
    features: FeatureConfig = field(default_factory=FeatureConfig)
    scoring: ensemble.Scoring = field(default_factory=ensemble.Scoring)
    cooldown_seconds: float = K.COOLDOWN_SECONDS
    include_mitre: bool = True


def train(labelled: DataFrame, features: list[str], record: str = "record_id", trees: int = 100, max_depth: int = 30,
          seed: int = 42) -> Models:
    """Isolation forest on benign rows, random forest on all rows of a labelled frame.

    Both fits pass over their rows many times, so the columns that they use are written once to the shared folder.
    """
    labelled = cut_lineage(labelled.select(*dict.fromkeys([record, "label", *features])), "train-rows")
    benign = labels.benign_only(labelled)
    return Models(IsolationForest(features=features, identifier=record, trees=trees, seed=seed).fit(benign),
                  fit_random_forest(labelled, features, trees=trees, max_depth=max_depth, seed=seed))


def score(df: DataFrame, models: Models, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Model outputs and ensemble columns; without a model its output is 0 or 'Unknown'.

    Any object with ``transform`` serves: a detector adds ``anomaly_score`` from 0 to 1, a classifier
    ``classification`` and, if it can, ``class_confidence`` and ``class_probabilities``.
    """
    forest = models.isolation_forest
    if forest is None:
        df = df.withColumn("anomaly_score", F.lit(0.0))
    else:
        # Features that the frame lacks count as 0; a foreign detector need not name its own.
        names = forest.getOrDefault(forest.features) if isinstance(forest, IsolationForestModel) else []
        absent = {n: F.lit(0.0) for n in names if n not in df.columns}
        df = forest.transform(df.withColumns(absent) if absent else df).drop(*absent)
    return ensemble.score(classify(df, models.random_forest), config=config.scoring)


def fingerprinted(scored: DataFrame, source: str = "src_ip") -> DataFrame:
    origin = F.col(source) if source in scored.columns else F.lit(None).cast("string")
    return scored.withColumn("fingerprint", cooldown.fingerprint(F.col("classification"), F.col("anomaly_score"), origin))


def results(scored: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Scored rows after cooldown suppression; alert-worthy rows always stay."""
    return cooldown.suppress(fingerprinted(scored), "fingerprint", config.features.ts, config.features.record,
                             config.cooldown_seconds, bypass=F.col("requires_alert"))


def analyze(records: DataFrame, models: Models, config: AnalysisConfig = AnalysisConfig(),
            baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, alerts) of canonical records.

    The scored rows feed both outputs and the cooldown's scans, so they are
    written once to the shared folder instead of being scored again.
    """
    rows = build_features(records, config.features, baseline)
    kept = cut_lineage(score(rows, models, config), "scored")
    found = alerts.generate_alerts(kept, config.features.record, config.features.ts, config.include_mitre)
    return results(kept, config), found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events scored, suppressed and explained; one row per kept result."""
    scored = ensemble.score(canonical_events(spark, sf_dir))
    kept = results(scored, AnalysisConfig(features=FeatureConfig(ts="ts")))
    told = alerts.explain(alerts.add_mitre(kept), confidence="class_confidence", priority="alert_priority")
    return told.select(
        "record_id", "src_ip", "dst_ip", "classification", "fingerprint", F.round("combined_risk_score", 6).alias("risk_score"),
        "risk_level", "alert_priority", "suggested_action", F.array_join("reasoning", "; ").alias("reasoning"),
        F.array_join("mitre_tactics", ", ").alias("mitre_tactics"), "summary")


def numeric_features(config: FeatureConfig) -> list[str]:
    return [d.name for d in definitions(config)]
