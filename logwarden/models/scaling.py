"""Standard scaling with the population deviation."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.scalars import quoted


def cleaned(name: str) -> Column:
    """Feature as a finite double; null, NaN and infinity become 0."""
    x = quoted(name).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


class _Columns(Params):
    features = Param(Params._dummy(), "features", "feature columns in order", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "suffix of the scaled columns", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(suffix="_scaled")


class PopulationScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean per feature", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "divisor per feature", TypeConverters.toListFloat)

    def scaled(self, i: int) -> Column:
        name = self.getOrDefault(self.features)[i]
        return (cleaned(name) - F.lit(self.getOrDefault(self.means)[i])) / F.lit(self.getOrDefault(self.scales)[i])

    def _transform(self, df: DataFrame) -> DataFrame:
        names, suffix = self.getOrDefault(self.features), self.getOrDefault(self.suffix)
        return df.withColumns({n + suffix: self.scaled(i) for i, n in enumerate(names)})


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Mean 0, deviation 1 (divisor n); a constant feature is only centred."""

    @keyword_only
    def __init__(self, features: list[str] | None = None, suffix: str = "_scaled"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        names = self.getOrDefault(self.features)
        row = df.agg(*[agg(cleaned(n)).alias(f"{a}{i}") for i, n in enumerate(names)
                       for a, agg in (("m", F.avg), ("s", F.stddev_pop))]).first()
        model = PopulationScalerModel()
        model._set(features=names, suffix=self.getOrDefault(self.suffix),
                   means=[row[f"m{i}"] or 0.0 for i in range(len(names))],
                   scales=[row[f"s{i}"] or 1.0 for i in range(len(names))])
        return model
