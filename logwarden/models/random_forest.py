"""Random-forest classification with balanced class weights."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from logwarden.models.scaling import cleaned


def clean_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: cleaned(f) for f in features})


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * n_class) per class; one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.select(label, (sums.select("n").scalar() / (sums.select("k").scalar() * F.col("_n"))).alias("weight"))


def fit_random_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 100, max_depth: int = 30,
                      min_leaf: int = 1, balanced: bool = True, seed: int = 42, max_bins: int = 32) -> PipelineModel:
    """Index labels alphabetically, assemble, train.

    Trees depend on the order of values only, so features are not scaled.
    """
    rows = clean_features(df, features)
    if balanced:
        rows = rows.join(F.broadcast(class_weights(df, label)), label)  # one row per class
    forest = RandomForestClassifier(
        labelCol="_label", featuresCol="_features", predictionCol="_prediction", probabilityCol="_probability",
        rawPredictionCol="_raw", numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed,
        featureSubsetStrategy="sqrt", maxBins=max_bins, **({"weightCol": "weight"} if balanced else {}))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    indexed = indexer.fit(rows)
    back = IndexToString(inputCol="_prediction", outputCol="classification", labels=indexed.labels)
    return Pipeline(stages=[indexed, VectorAssembler(inputCols=features, outputCol="_features"), forest, back]).fit(rows)


def feature_list(model: PipelineModel) -> list[str]:
    return model.stages[1].getInputCols()


def classes(model: PipelineModel) -> list[str]:
    return model.stages[3].getLabels()


def classify(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Add ``classification``, ``class_probabilities`` and ``class_confidence``; 'Unknown' without a model.

    Features the frame lacks count as 0.
    """
    if model is None:
        return df.withColumns({"classification": F.lit("Unknown"), "class_confidence": F.lit(0.0),
                               "class_probabilities": F.create_map().cast("map<string,double>")})
    if not (isinstance(model, PipelineModel) and len(model.stages) == 4 and hasattr(model.stages[3], "getLabels")):
        # Any other model: its transform gives the classification, and the rest where it can.
        out = model.transform(df)
        if "classification" not in out.columns:
            raise ValueError("a classifier must add a column classification")
        absent = {"class_confidence": F.lit(1.0), "class_probabilities": F.create_map(F.col("classification"), F.lit(1.0))}
        return out.withColumns({n: c for n, c in absent.items() if n not in out.columns})
    features = feature_list(model)
    inputs = df.select("*", *[(cleaned(f) if f in df.columns else F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(features)])
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_features")
    predicted = model.stages[3].transform(model.stages[2].transform(assembler.transform(inputs)))
    p = vector_to_array("_probability")
    names = classes(model)
    out = predicted.withColumns({
        "class_confidence": F.array_max(p),
        "class_probabilities": F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.slice(p, 1, len(names)))})
    return out.drop("_features", "_raw", "_probability", "_prediction", *[f"_f{i}" for i in range(len(features))])


def feature_importance(model: PipelineModel, spark, top: int | None = 10) -> DataFrame:
    """Features by falling importance."""
    weights = model.stages[2].featureImportances.toArray()
    table = spark.createDataFrame([(f, float(w)) for f, w in zip(feature_list(model), weights)], "feature string, importance double")
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered
