"""Relevance models over feature columns: fit, score, importance. MLlib trains them on the cluster."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["size", "symbols", "capitals", "marks"]
SEED = 1337


def _learner(kind: str):
    """1000 iterations at most; depth 6; 100 trees of depth 10; 200 rounds are cut to 20 for MLlib's boosting."""
    if kind == "logistic":
        return LogisticRegression(weightCol="weight", maxIter=1000, standardization=True)
    if kind == "tree":
        return DecisionTreeClassifier(weightCol="weight", maxDepth=6, seed=SEED)
    if kind == "forest":
        return RandomForestClassifier(weightCol="weight", numTrees=100, maxDepth=10, seed=SEED)
    if kind == "boosted":
        return GBTClassifier(weightCol="weight", maxIter=20, maxDepth=5, seed=SEED)
    raise ValueError(f"unknown model {kind}")


def balanced(rows: DataFrame) -> DataFrame:
    """rows(label 0 or 1, ...) with weights that give both classes the same total; one class alone is an error."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"a model needs both classes, found {sorted(counts, key=str)}")
    total = sum(counts.values())
    return rows.withColumn("weight", F.when(F.col("label") == 1, total / 2 / counts[1]).otherwise(total / 2 / counts[0]))


def fit(rows: DataFrame, kind: str, features: list[str] = FEATURES) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), _learner(kind)]).fit(rows)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(doc_id, label, score), score the probability of class 1."""
    return model.transform(rows).select("doc_id", "label", vector_to_array("probability")[1].alias("score"))


def importance(model: PipelineModel) -> dict[str, float]:
    """Features by importance, or by the size of the coefficient for the regression."""
    names, last = model.stages[0].getInputCols(), model.stages[-1]
    weights = [abs(float(w)) for w in last.coefficients] if hasattr(last, "coefficients") else [float(w) for w in last.featureImportances]
    return dict(zip(names, weights))
