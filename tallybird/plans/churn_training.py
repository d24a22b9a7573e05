"""Staged churn artefacts: feature table, training split, fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.operators import churn_models as models
from tallybird.operators.churn_features import churn_features
from tallybird.operators.classification import select_best_model
from tallybird.plans.warehouse import staged, star_schema
from tallybird.sources.workspace import is_complete, staging_path


def features_of(spark: SparkSession, folder: str) -> DataFrame:
    star = star_schema(spark, folder)
    return churn_features(
        star["customers"], star["orders"], star["reviews"], star["marketing_campaigns"]
    )


def staged_features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table, written once: training passes over it many times."""
    return staged(spark, folder, "churn_features", lambda: features_of(spark, folder))


def staged_split(spark: SparkSession, folder: str):
    """(train, test, matrix columns, levels), the split written once."""
    split, columns, levels = models.split_input(staged_features(spark, folder))
    rows = staged(spark, folder, "churn_split", lambda: split)
    train, test = (rows.where(F.col("is_test") == part).drop("is_test") for part in (0, 1))
    return train, test, columns, levels


def scored_test(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Fit one model on the training part and score the test part. The fitted model is stored."""
    train, test, columns, levels = staged_split(spark, folder)
    path = f"{staging_path(spark, folder)}/churn/{name.replace(' ', '_')}"
    if name == models.FOREST:
        model = models.fit_forest(train, columns, f"{path}/model")
    else:
        model = models.fit_logistic(train)
    models.save(spark, models.Trained(name, model, columns, levels), path)
    return models.score(model, test)


def stored_model(spark: SparkSession, folder: str, name: str) -> models.Trained:
    path = f"{staging_path(spark, folder)}/churn/{name.replace(' ', '_')}"
    if not is_complete(spark, f"{path}/about"):
        scored_test(spark, folder, name)
    return models.load(spark, path)


def fitted_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(model, customer_id, label, score) of the test part under both fitted models, written once:
    whoever compares models reads it instead of scoring again."""
    _, test, _, _ = staged_split(spark, folder)

    def scored(name: str) -> DataFrame:
        return models.score(stored_model(spark, folder, name).model, test)

    parts = [
        staged(
            spark, folder, f"scored_{name.replace(' ', '_')}", lambda name=name: scored(name)
        ).select(
            F.lit(name).alias("model"),
            "customer_id",
            F.col("churned").alias("label"),
            F.col("churn_probability").alias("score"),
        )
        for name in (models.LOGISTIC, models.FOREST)
    ]
    return parts[0].unionByName(parts[1])


def best_model(spark: SparkSession, folder: str) -> models.Trained:
    """The model with the better recall on the test part, the only one loaded; a tie goes to the
    forest."""
    winner = select_best_model(fitted_scores(spark, folder), models.FOREST).first()
    return stored_model(spark, folder, winner["best_model"])
