from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallybird.operators import logistic_newton as newton
from tallybird.operators.categories import category_table, dense_view, sparse_features
from tallybird.operators.churn_features import NUMERIC


def _features(spark, levels):
    """Customers with the given (a, b) levels."""
    data = [(k, k % 2, a, b) for k, (a, b) in enumerate(levels)]
    df = spark.createDataFrame(data, "customer_id int, churned int, a string, b string")
    return df.select("*", *[F.lit(1.0).alias(c) for c in NUMERIC])


def test_places_follow_columns_and_levels(spark):
    df = _features(spark, [("z", "2"), ("y", None), (None, "10"), ("x", "10"), ("y", "3")])
    table = category_table(df, ["a", "b"], first=5)
    assert rows(table) == [("a", "y", 5), ("a", "z", 6), ("b", "2", 7), ("b", "3", 8)]
    sparse = sparse_features(df, table, ["a", "b"])
    assert sorted((r["customer_id"], r["places"]) for r in sparse.collect()) == [(0, [6, 7]), (1, [5]), (2, []), (3, []), (4, [5, 8])]
    # aligned to an older table: a level it does not know sets nothing
    old = table.where("level <> 'y'")
    assert sorted((r["customer_id"], r["places"]) for r in sparse_features(df, old, ["a", "b"]).collect())[4] == (4, [8])
    view = dense_view(sparse, table, {"a_z": ("a", "z"), "b_3": ("b", "3"), "b_gone": ("b", "gone")})
    assert rows(view.select("customer_id", "a_z", "b_3", "b_gone")) == [(0, 1, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 1, 0)]
    assert rows(category_table(df.limit(0), ["a", "b"])) == [] and sparse_features(df.limit(0), table, ["a", "b"]).collect() == []


def test_a_million_levels_and_a_hot_one(spark):
    n = 1_000_000
    name = lambda c: F.format_string("level%07d", c)
    df = spark.range(int(1.5 * n)).select(
        F.col("id").alias("customer_id"), (F.col("id") % 2).cast("int").alias("churned"),
        name(F.when(F.col("id") < n, F.col("id")).otherwise(17)).alias("a"), F.lit("one").alias("b"),
        *[F.lit(0.0).alias(c) for c in NUMERIC],
    )
    table = category_table(df, ["a", "b"], first=0)
    found = table.agg(F.count("*"), F.min("place"), F.max("place"), F.count_if(F.col("level") != name(F.col("place") + 1))).first()
    assert tuple(found) == (n - 1, 0, n - 2, 0)
    sparse = sparse_features(df, table, ["a", "b"])
    wrong = F.coalesce(F.get("places", F.lit(0)), F.lit(-1)) != F.when(F.col("customer_id") < n, F.col("customer_id")).otherwise(17) - 1
    assert tuple(sparse.agg(F.count("*"), F.count_if(wrong)).first()) == (int(1.5 * n), 0)


def _labelled(spark, n=3000, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3)) * [1, 10, 0.1] + [5, 0, 0]
    y = (draw.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 5 + 0.2 * x[:, 1] - 1)))).astype(int)
    data = [(*map(float, r), 7.0, int(label)) for r, label in zip(x, y)]
    return spark.createDataFrame(data, "a double, b double, c double, same double, churned int"), x, y


@pytest.mark.parametrize("balanced", [True, False])
def test_newton_finds_the_optimum(spark, balanced):
    df, x, y = _labelled(spark)
    model = newton.fit_newton(df, ["a", "b", "c", "same"], balanced=balanced)
    assert model.gradient < 1e-10 and model.steps < 15
    scaled = np.column_stack([(x - x.mean(0)) / x.std(0), np.zeros(len(x)), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    p = 1 / (1 + np.exp(-scaled @ model.beta))
    slope = scaled.T @ (w * (p - y)) + np.append(model.beta[:-1], 0)
    assert np.abs(slope / len(y)).max() < 1e-9 and model.beta[3] == 0
    got = df.select("a", newton.newton_probability(model).alias("p")).toPandas().sort_values("a")
    assert np.allclose(got["p"], p[np.argsort(x[:, 0])], atol=1e-9)


def test_newton_with_separable_rows_nulls_and_one_label(spark):
    df = spark.createDataFrame([(float(k), int(k > 10), None) for k in range(21)] + [(None, 1, 2.0)], "a double, churned int, b double")
    model = newton.fit_newton(df.repartition(5), ["a", "b"])
    assert model.gradient < 1e-10 and np.isfinite(model.beta).all()
    with pytest.raises(ValueError):
        newton.fit_newton(df.where("churned = 1"), ["a"])
