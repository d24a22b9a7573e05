"""Churn classifiers: training, storage, scoring. Logistic regression by MLlib, the forest as a table of
nodes (``forest_table.py``)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.operators.churn_features import (
    NUMERIC,
    align,
    category_levels,
    dummy_columns,
    one_hot,
    stratified_split,
)
from tallybird.operators.forest_table import (
    ForestTable,
    fit_forest_table,
    forest_importance,
    load_forest_table,
    save_forest_table,
    score_forest_table,
)

# Model names, training settings and the limits of the risk levels.
LOGISTIC, FOREST = "Logistic Regression", "Random Forest"
SEED = 42
MAX_ITERATIONS = 1000
TREES = 200
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline with what is needed to rebuild its input."""

    name: str
    model: PipelineModel | ForestTable
    columns: list[str]
    levels: dict[str, list[str]]


def model_columns(levels: dict[str, list[str]]) -> list[str]:
    return [*NUMERIC, *[name for name, _, _ in dummy_columns(levels)]]


def model_input(
    features: DataFrame,
    levels: dict[str, list[str]],
    columns: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """(customer_id, churned, keep..., features vector) in the trained column order."""
    keep = ["customer_id", "churned", *keep]
    matrix = align(one_hot(features, levels, keep), columns, keep)
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return matrix.select(*keep, array_to_vector(values).alias("features"))


def split_input(features: DataFrame) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    levels = category_levels(features)
    columns = model_columns(levels)
    return stratified_split(model_input(features, levels, columns)), columns, levels


def _balanced(train: DataFrame) -> tuple[DataFrame, int]:
    """Add the weight n / (2 n_label), so that both labels weigh the same."""
    counts = {r["churned"]: r["count"] for r in train.groupBy("churned").count().collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    for label, n_label in counts.items():
        weight = F.when(F.col("churned") == label, n / (2.0 * n_label)).otherwise(weight)
    return train.withColumn("weight", weight), n


def _fit(train: DataFrame, classifier) -> PipelineModel:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, classifier]).fit(train)


def fit_logistic(train: DataFrame) -> PipelineModel:
    """L2 penalty of strength 1 on the summed loss, i.e. 1 / n on MLlib's mean loss."""
    weighted, n = _balanced(train)
    return _fit(
        weighted,
        LogisticRegression(
            featuresCol="scaled", labelCol="churned", weightCol="weight", regParam=1.0 / n,
            elasticNetParam=0.0, standardization=False, maxIter=MAX_ITERATIONS,
        ),
    )


def fit_forest(train: DataFrame, columns: Sequence[str], path: str, trees: int = TREES) -> ForestTable:
    """A forest of unbounded depth on all rows, stored in ``path``."""
    rows = train.withColumn("_values", vector_to_array("features"))
    return fit_forest_table(rows, columns, path, trees=trees, seed=SEED, vector="_values")


def _probability(model: PipelineModel | ForestTable, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(customer_id, keep..., churn_probability)."""
    if isinstance(model, ForestTable):
        rows = rows.withColumn("_values", vector_to_array("features"))
        return score_forest_table(model, rows, "customer_id", keep, vector="_values")
    probability = vector_to_array("probability")[1].alias("churn_probability")
    return model.transform(rows).select("customer_id", *keep, probability)


def score(model: PipelineModel | ForestTable, rows: DataFrame) -> DataFrame:
    return _probability(model, rows, ["churned"])


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability >= HIGH_RISK, "HIGH")
        .when(probability >= MEDIUM_RISK, "MEDIUM")
        .otherwise("LOW")
    )


def save(spark: SparkSession, trained: Trained, path: str) -> None:
    forest = isinstance(trained.model, ForestTable)
    if forest:
        save_forest_table(spark, trained.model, f"{path}/model")
    else:
        trained.model.write().overwrite().save(f"{path}/model")
    about = {"name": trained.name, "forest": forest, "columns": trained.columns, "levels": trained.levels}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Trained:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    model = (load_forest_table(spark, f"{path}/model") if about["forest"] else PipelineModel.load(f"{path}/model"))
    return Trained(about["name"], model, about["columns"], about["levels"])


def score_customers(
    features: DataFrame, trained: Trained, customer_ids: Sequence[int] | None = None
) -> DataFrame:
    """Probability and risk level per customer. No ids, or an empty list, means every customer."""
    if customer_ids:
        features = features.where(F.col("customer_id").isin(list(customer_ids)))
    rows = model_input(features, trained.levels, trained.columns, keep=["customer_name"])
    return _probability(trained.model, rows, ["customer_name"]).withColumn(
        "risk_level", risk_level(F.col("churn_probability"))
    )


def by_risk(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("churn_probability"), "customer_id")


def churn_predictions(
    features: DataFrame, trained: Trained, customer_ids: Sequence[int] | None = None
) -> DataFrame:
    """``score_customers``, the likeliest to leave first."""
    return by_risk(score_customers(features, trained, customer_ids))


def feature_importance(spark: SparkSession, trained: Trained, k: int | None = 10) -> DataFrame:
    """Features by importance; empty for a model that has none."""
    if isinstance(trained.model, ForestTable):
        found = forest_importance(spark, trained.model)
    else:
        found = spark.createDataFrame([], "feature string, importance double")
    ranked = found.orderBy(F.desc("importance"), "feature")
    return ranked if k is None else ranked.limit(k)
