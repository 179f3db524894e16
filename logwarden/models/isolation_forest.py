"""Isolation forest as a Spark ML estimator.

Rows are given to trees by a seeded hash, each tree of at most 256 rows is
grown in its own task, and the finished forest (its size is bounded by the
parameters, not by the data) scores rows in Arrow batches.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window as W, functions as F

from logwarden.models.scaling import PopulationScaler, PopulationScalerModel

_NODES = "tree int, node int, feature int, cut double, low int, high int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(pdf: pd.DataFrame, features: int, max_depth: int, seed: int) -> pd.DataFrame:
    """Nodes of one tree; a leaf has feature -1 and its path length."""
    tree = int(pdf["tree"].iloc[0])
    data = pdf.sort_values("_h")[[f"x{i}" for i in range(features)]].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    todo = [(np.arange(len(data)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][side] = number
        spread = np.flatnonzero(np.ptp(data[rows], axis=0) > 0) if len(rows) > 1 else np.array([])
        if depth >= max_depth or len(spread) == 0:
            nodes.append([tree, number, -1, 0.0, -1, -1, depth + average_path(len(rows))])
            continue
        f = int(rng.choice(spread))
        x = data[rows, f]
        cut = float(rng.uniform(x.min(), x.max()))
        left = x <= cut
        if left.all():  # the draw hit the maximum
            cut = float(np.nextafter(x.max(), -np.inf))
            left = x <= cut
        nodes.append([tree, number, f, cut, -1, -1, 0.0])
        todo += [(rows[~left], depth + 1, number, 5), (rows[left], depth + 1, number, 4)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "path"])


class Forest:
    """All trees in flat arrays."""

    def __init__(self, feature, cut, low, high, path, roots, sample):
        self.feature, self.cut = np.asarray(feature, dtype=np.int32), np.asarray(cut, dtype=float)
        self.low, self.high = np.asarray(low, dtype=np.int32), np.asarray(high, dtype=np.int32)
        self.path, self.roots = np.asarray(path, dtype=float), np.asarray(roots, dtype=np.int32)
        self.sample = sample

    def scores(self, x: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 to the minus of relative mean depth."""
        parts = [self._scores(x[i:i + chunk]) for i in range(0, len(x), chunk)]
        return np.concatenate(parts) if parts else np.empty(0)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            goes_low = x[rows, np.maximum(feature, 0)] <= self.cut[at]
            at = np.where(inner, np.where(goes_low, self.low[at], self.high[at]), at)
        depth = self.path[at].mean(axis=1)
        return np.power(2.0, -depth / max(average_path(self.sample), 1e-12))


class _ForestParams(Params):
    features = Param(Params._dummy(), "features", "feature columns in order", TypeConverters.toListString)
    identifier = Param(Params._dummy(), "identifier", "column that identifies a row", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    sample = Param(Params._dummy(), "sample", "rows per tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "expected share of anomalies", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    output = Param(Params._dummy(), "output", "score column", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(trees=100, sample=256, contamination=0.01, seed=42, output="anomaly_score", identifier="record_id")


class IsolationForestModel(Model, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    forest = Param(Params._dummy(), "forest", "trees as JSON", TypeConverters.toString)
    means = Param(Params._dummy(), "means", "scaler means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scaler divisors", TypeConverters.toListFloat)
    offset = Param(Params._dummy(), "offset", "score threshold learned from contamination", TypeConverters.toFloat)

    def _scaler(self) -> PopulationScalerModel:
        names = self.getOrDefault(self.features)
        model = PopulationScalerModel()
        return model._set(features=names, means=self.getOrDefault(self.means), scales=self.getOrDefault(self.scales))

    def with_raw(self, df: DataFrame, name: str) -> DataFrame:
        """Add the raw forest score (higher is more anomalous)."""
        packed = json.loads(self.getOrDefault(self.forest))
        arrays = {k: np.asarray(v) if isinstance(v, list) else v for k, v in packed.items()}
        scaler, n = self._scaler(), len(self.getOrDefault(self.features))
        # At most trees * (2 * sample - 1) nodes, whatever the data size.
        shared = df.sparkSession.sparkContext.broadcast(arrays)

        @F.pandas_udf("double")
        def raw(x: pd.DataFrame) -> pd.Series:
            return pd.Series(Forest(**shared.value).scores(x.to_numpy(dtype=float)))

        return df.withColumn(name, raw(F.struct(*[scaler.scaled(i).alias(f"x{i}") for i in range(n)])))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Score = 1 / (1 + exp(decision)), decision = -raw - offset."""
        scored = self.with_raw(df, "_raw")
        decision = -F.col("_raw") - F.lit(self.getOrDefault(self.offset))
        return scored.withColumn(self.getOrDefault(self.output), 1.0 / (1.0 + F.exp(decision))).drop("_raw")


class IsolationForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit on normal rows only; the caller filters them."""

    @keyword_only
    def __init__(self, features: list[str] | None = None, identifier: str = "record_id", trees: int = 100, sample: int = 256,
                 contamination: float = 0.01, seed: int = 42, output: str = "anomaly_score"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> IsolationForestModel:
        get = self.getOrDefault
        names, trees, seed, key = get(self.features), get(self.trees), get(self.seed), get(self.identifier)
        scaler = PopulationScaler(features=names).fit(df)
        count = df.count()
        size = min(get(self.sample), count)

        # A pool of a few rows per wanted sample row, so the hash per tree runs on the pool only.
        unit = float(2 ** 32)
        share = min(1.0, 2.0 * trees * size / max(count, 1))
        position = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(2 ** 32)) / F.lit(unit)
        pool = df.where(position(F.col(key), F.lit(seed)) < share) if share < 1.0 else df
        pool_rows = count * share
        chance = min(1.0, 2.0 * size / max(pool_rows, 1.0) + 20.0 / max(pool_rows, 1.0))
        scaled = pool.select(F.col(key).alias("_id"), *[scaler.scaled(i).alias(f"x{i}") for i in range(len(names))])
        drawn = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                                   lambda t: position(F.col("_id"), t, F.lit(seed + 1)) < chance))
        rows = scaled.select("*", drawn.alias("tree")).withColumn("_h", F.xxhash64("_id", "tree", F.lit(seed + 1)))
        # About 2 * sample rows per tree reach this window.
        picked = rows.withColumn("_n", F.row_number().over(W.partitionBy("tree").orderBy("_h", "_id"))).where(F.col("_n") <= size)
        depth = max(1, math.ceil(math.log2(max(size, 2))))
        width = len(names)
        nodes = picked.groupBy("tree").applyInPandas(lambda pdf: grow_tree(pdf, width, depth, seed), _NODES).toPandas()

        model = IsolationForestModel()
        model._set(features=names, identifier=key, trees=trees, sample=get(self.sample), seed=seed, output=get(self.output),
                   contamination=get(self.contamination), forest=_pack(nodes, size), means=scaler.getOrDefault(scaler.means),
                   scales=scaler.getOrDefault(scaler.scales), offset=0.0)
        # Threshold: the raw score that the expected share of training rows exceeds.
        raw = model.with_raw(df, "_raw").agg(F.percentile_approx(-F.col("_raw"), get(self.contamination), 100000)).first()[0]
        return model._set(offset=float(raw if raw is not None else -0.5))


def _pack(nodes: pd.DataFrame, sample: int) -> str:
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    sizes = nodes.groupby("tree").size()
    first = sizes.cumsum() - sizes
    base = nodes["tree"].map(first)
    child = lambda c: np.where(nodes[c] >= 0, nodes[c] + base, -1).astype(int).tolist()
    return json.dumps({"feature": nodes["feature"].tolist(), "cut": nodes["cut"].tolist(), "low": child("low"),
                       "high": child("high"), "path": nodes["path"].tolist(), "roots": first.tolist(), "sample": int(sample)})
