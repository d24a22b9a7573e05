"""Every query against its SQL counterpart in another engine, or against invariants."""

from __future__ import annotations

import duckdb
import pytest
from conftest import TABLES

from tallybird.plans.oracle import ORACLE_SQL
from tallybird.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    return connection


def _clean(value):
    return 0.0 if isinstance(value, float) and value == 0 else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    result = duck.execute(ORACLE_SQL[name])
    theirs = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(theirs)
    columns = sorted(theirs)
    ours = sorted((tuple(_clean(r[c]) for c in columns) for r in df.collect()), key=repr)
    order = [theirs.index(c) for c in columns]
    expected = sorted((tuple(_clean(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert ours == expected


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_forecasts_cover_the_right_days(spark, data_dir):
    history = QUERIES["daily_revenue_filled"](spark, data_dir).toPandas()
    ahead = QUERIES["forecast_90day"](spark, data_dir).toPandas()
    total = ahead[ahead["series"] == "all"].sort_values("ds")
    assert len(total) == 90
    gaps = {(b - a).days for a, b in zip([history["ds"].max(), *total["ds"]], total["ds"])}
    assert gaps == {1}
    assert (ahead["yhat_lower"] <= ahead["yhat"]).all()
    assert (ahead["yhat"] <= ahead["yhat_upper"]).all()
    holdout = QUERIES["seasonal_holdout_forecast"](spark, data_dir).toPandas()
    assert (holdout.groupby("series").size() == 60).all()


def test_churn_models(spark, data_dir):
    everyone = QUERIES["churn_features"](spark, data_dir).count()
    for name in ("churn_logistic", "churn_random_forest"):
        scored = QUERIES[name](spark, data_dir).toPandas()
        assert abs(len(scored) - 0.2 * everyone) <= 1
        assert scored["churn_probability"].between(0, 1).all()
    predictions = QUERIES["churn_predictions"](spark, data_dir).toPandas()
    assert len(predictions) == everyone
    assert predictions["churn_probability"].is_monotonic_decreasing
    high = predictions["risk_level"] == "HIGH"
    assert (high == (predictions["churn_probability"] >= 0.7)).all()
    importance = QUERIES["feature_importance"](spark, data_dir).toPandas()
    assert len(importance) == 10 and importance["importance"].is_monotonic_decreasing
    assert QUERIES["model_roundtrip"](spark, data_dir).first()["max_difference"] == 0


def test_isolation_forest_flags_the_share_asked_for(spark, data_dir):
    flags = QUERIES["isolation_forest"](spark, data_dir).toPandas()
    share = (flags["isolation_forest_flag"] == "Anomaly").mean()
    assert 0.03 <= share <= 0.055
    assert len(QUERIES["known_anomaly_check_forest"](spark, data_dir).collect()) == 1
