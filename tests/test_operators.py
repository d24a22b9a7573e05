"""Hand-written edge cases per operator: ties, NULLs, gaps, empty and constant input, hot keys."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallybird.operators import (
    anomaly,
    business,
    classification,
    cleaning,
    daily,
    explore,
    forecast,
    isolation_forest,
    rfm,
    sentiment,
)
from tallybird.operators import churn_features as churn
from tallybird.operators import churn_models as models
from tallybird.schemas import RAW, STAR

DAY = dt.date(2024, 1, 1)


def make_orders(spark, data):
    """(customer, day offset or date, revenue, status) -> orders."""
    out = []
    for i, (customer, day, revenue, status) in enumerate(data):
        date = DAY + dt.timedelta(days=day) if isinstance(day, int) else day
        money = None if revenue is None else Decimal(str(revenue))
        out.append(
            (i, customer, 1, date, 1, money, Decimal("0.10"), "Cod", 3, status, money)
        )
    return spark.createDataFrame(out, STAR["orders"])


D = "Delivered"


# ---- cleaning


def test_clean_customers(spark):
    raw = spark.createDataFrame(
        [
            (1, "a", 20, "Male", " NEW york\t", "2024-01-01", "New"),
            (1, "a", 20, "Male", " NEW york\t", "2024-01-01", "New"),
            (2, "b", None, None, "new york", "2024-01-11", "New"),
            (3, "c", 31, "Female", "New York", "2024-01-05", "New"),
        ],
        RAW["customers"],
    )
    got = {r["customer_id"]: r for r in cleaning.clean_customers(raw).collect()}
    assert len(got) == 3
    assert {r["city"] for r in got.values()} == {"New York"}
    assert got[2]["age"] == 25.5 and got[2]["gender"] == "Unknown"
    assert got[1]["tenure_days"] == 10 and got[2]["tenure_days"] == 0


def test_duplicates_are_judged_before_normalising(spark):
    order = (1, 1, 1, "2024-01-01", 2, 10.0, 0.1, "cod", None, D)
    raw = spark.createDataFrame(
        [order, (*order[:7], "COD", *order[8:]), (2, 1, 1, "2024-01-01", -1, 9.0, 0.0, "x", 9, D),
         (3, 1, 1, "2024-01-01", 1, 0.0, 0.0, "x", 9, D),
         (4, 1, 1, "2024-01-01", None, 5.0, 0.0, "x", 9, D),
         (5, 1, 1, "2024-01-01", 3, 3.333, 0.15, "net banking ", 4, D)],
        RAW["orders"],
    )
    got = sorted(cleaning.clean_orders(raw).collect(), key=lambda r: (r["order_id"], r["quantity"]))
    assert [r["order_id"] for r in got] == [1, 1, 5]
    assert [r["payment_method"] for r in got] == ["Cod", "Cod", "Net Banking"]
    assert [r["delivery_time"] for r in got] == [4.0, 4.0, 4.0]  # median without removed rows
    assert [r["revenue"] for r in got] == [Decimal("18.00"), Decimal("18.00"), Decimal("8.50")]


def test_clean_products_and_marketing(spark):
    products = spark.createDataFrame(
        [(1, "c", "b", 50.0, 100.0, -5), (2, "c", "b", 75.0, 100.0, 10),
         (3, "c", "b", 1.0, 3.0, 15), (4, "c", "b", 1.0, 0.0, None)],
        RAW["products"],
    )
    got = {r["product_id"]: r for r in cleaning.clean_products(products).collect()}
    assert [got[i]["inventory"] for i in (1, 2, 3, 4)] == [12, 10, 15, 12]  # 12.5 is cut to 12
    assert got[3]["margin_pct"] == Decimal("0.667") and got[4]["margin_pct"] is None
    marketing = spark.createDataFrame(
        [(1, 1, "c", None, 1, 0), (2, 1, "c", 1.0, 1, 0), (3, 1, "c", 4.0, 1, 0)], RAW["marketing"]
    )
    spends = sorted(r["spend"] for r in cleaning.clean_marketing(marketing).collect())
    assert spends == [1.0, 2.5, 4.0]
    approx = cleaning.clean_marketing(marketing, approx=True)
    assert approx.where("spend IS NULL").count() == 0


# ---- business questions


def test_rank_leaves_gaps_after_ties(spark):
    orders = make_orders(spark, [(1, 0, 10, D), (2, 0, 10, D), (3, 0, 5, D), (4, 0, 99, "Pending")])
    got = [(r["customer_id"], r["spend_rank"])
           for r in business.top_customers_ranked(orders).collect()]
    assert got == [(1, 1), (2, 1), (3, 3)]
    assert business.top_customers_ranked(orders, k=2).count() == 2


def test_tiers_and_average(spark):
    orders = make_orders(spark, [(1, 0, 5000, D), (1, 0, 1500, D), (1, 0, 1499.99, D),
                                 (1, 0, None, D), (1, 0, 9000, "Pending")])
    tiers = [r["order_tier"] for r in business.order_tiers(orders).orderBy("order_id").collect()]
    assert tiers == ["High Value", "Medium Value", "Low Value", "Low Value"]
    even = make_orders(spark, [(1, 0, 7, D), (2, 0, 7, D)])
    assert business.above_average_orders(even).count() == 0  # strictly above
    assert business.total_revenue(even.where("false")).first()["total_revenue"] is None


def test_running_and_rolling_count_existing_days(spark):
    orders = make_orders(spark, [(1, d, d + 1, D) for d in (0, 1, 5, 9, 10, 11, 30, 31)])
    running = [float(r["running_total"]) for r in business.running_revenue(orders).collect()]
    revenue = [1, 2, 6, 10, 11, 12, 31, 32]
    assert running == list(np.cumsum(revenue))
    rolling = [float(r["rolling_7day_avg"]) for r in business.rolling_revenue(orders).collect()]
    want = pd.Series(revenue).rolling(7, min_periods=1).mean()
    assert rolling == pytest.approx(list(want), abs=0.0051)


def test_month_change_skips_absent_months(spark):
    months = [dt.date(2024, 1, 31), dt.date(2024, 4, 1), dt.date(2024, 4, 30)]
    orders = make_orders(spark, [(1, m, 10, D) for m in months])
    got = [(r["month"].month, r["prev_month_revenue"], r["change"])
           for r in business.product_monthly_change(orders).collect()]
    assert got == [(1, None, None), (4, Decimal("10.00"), Decimal("10.00"))]


def test_retention_needs_the_month_before(spark):
    orders = make_orders(
        spark,
        [(1, dt.date(2023, 12, 31), 1, D), (1, dt.date(2024, 1, 1), 1, D),
         (1, dt.date(2024, 3, 1), 1, D), (2, dt.date(2024, 1, 5), 1, D),
         (None, dt.date(2024, 1, 5), 1, D), (2, dt.date(2023, 12, 5), 1, "Cancelled")],
    )
    got = [tuple(r)[1:] for r in business.monthly_retention(orders).collect()]
    assert got == [(1, 0, Decimal("0.0")), (2, 1, Decimal("50.0")), (1, 0, Decimal("0.0"))]


def test_roi_counts_each_touch_once_per_order(spark):
    orders = make_orders(spark, [(1, 0, 10, D), (1, 1, 30, D), (1, 1, 99, "Pending")])
    touches = spark.createDataFrame(
        [(1, 1, "A", Decimal("5"), 1, 1), (2, 1, "A", Decimal("5"), 1, 0),
         (3, 2, "A", Decimal("7"), 1, 1), (4, 9, "B", Decimal("0"), 1, 1),
         (5, None, "C", Decimal("3"), 1, 0)],
        STAR["marketing_campaigns"],
    )
    got = {r["campaign"]: tuple(r)[1:] for r in business.campaign_roi(touches, orders).collect()}
    assert got["A"] == (5, Decimal("27.00"), 3, Decimal("40.00"), Decimal("48.1"))
    assert got["B"] == (1, Decimal("0.00"), 1, None, None)  # every touch converted, none matched
    assert got["C"][3:] == (Decimal("0.00"), Decimal("-100.0"))


def test_roi_with_a_hot_customer_stays_exact(spark):
    orders = make_orders(spark, [(1, 0, 2, D)] * 300)
    touches = spark.createDataFrame(
        [(i, 1, "A", Decimal("1"), 1, i % 2) for i in range(300)], STAR["marketing_campaigns"]
    )
    got = business.campaign_roi(touches, orders).first()
    assert got["total_touches"] == 90_000 and got["attributed_revenue"] == 150 * 600


def test_churn_rules_measure_from_the_last_order_of_any_status(spark):
    orders = make_orders(spark, [(1, 0, 1, D), (2, 61, 1, D), (3, 60, 1, D), (9, 121, 1, "Pending")])
    got = {r["customer_id"]: r["churn_risk"] for r in business.churn_risk_rules(orders).collect()}
    assert got == {1: "High Risk", 2: "Low Risk", 3: "Medium Risk"}


# ---- customer analytics


def _scores(spark, recency, frequency, monetary):
    data = [(i, int(r), int(f), Decimal(str(m)))
            for i, (r, f, m) in enumerate(zip(recency, frequency, monetary))]
    df = spark.createDataFrame(
        data, "customer_id long, recency_days int, frequency long, monetary decimal(28,2)"
    )
    return rfm.rfm_scores(df).orderBy("customer_id").toPandas()


@pytest.mark.parametrize("n", [5, 7, 23, 400])
def test_scores_equal_pandas(spark, n):
    rng = np.random.default_rng(n)
    recency, monetary = rng.permutation(n * 3)[:n], np.round(rng.permutation(n) * 1.37 + 5, 2)
    frequency = rng.integers(1, 4, n)
    got = _scores(spark, recency, frequency, monetary)
    rank = pd.Series(frequency).rank(method="first")
    assert list(got["r_score"]) == list(pd.qcut(recency, 5, labels=[5, 4, 3, 2, 1]).astype(int))
    assert list(got["f_score"]) == list(pd.qcut(rank, 5, labels=[1, 2, 3, 4, 5]).astype(int))
    assert list(got["m_score"]) == list(pd.qcut(monetary, 5, labels=[1, 2, 3, 4, 5]).astype(int))


def test_scores_with_one_shared_frequency_and_constant_value(spark):
    got = _scores(spark, [3] * 50, [1] * 50, [9] * 50)
    assert set(got["r_score"]) == {5} and set(got["m_score"]) == {1}
    assert list(got["f_score"]) == sorted(got["f_score"])  # ties in order of id
    assert got["f_score"].value_counts().to_dict() == {k: 10 for k in range(1, 6)}


def test_segment_rules(spark):
    grid = spark.sql("SELECT r_score, f_score FROM (SELECT explode(sequence(1,5)) r_score), "
                     "(SELECT explode(sequence(1,5)) f_score)")
    got = {(r["r_score"], r["f_score"]): r["segment"] for r in rfm.rfm_segments(grid).collect()}
    assert got[5, 5] == got[4, 4] == "Champions"
    assert got[3, 4] == "Loyal Customers" and got[5, 2] == "Potential Loyalists"
    assert got[2, 3] == "At Risk" and got[1, 2] == "Lost" and got[5, 1] == "Needs Attention"


def test_rfm_base(spark):
    orders = make_orders(spark, [(1, 0, None, D), (2, 5, 3, D), (2, 9, 4, D), (3, 50, 1, "Pending")])
    assert rows(rfm.rfm_base(orders)) == [(1, 10, 1, Decimal("0.00")), (2, 1, 2, Decimal("7.00"))]


# ---- churn


def _features(spark):
    customers = spark.createDataFrame(
        [(i, f"n{i}", 30, "Male", "X", DAY, "New", 5) for i in range(1, 5)], STAR["customers"]
    )
    orders = make_orders(spark, [(1, 0, 10, D), (1, 0, 20, D), (2, 200, 5, D), (3, 0, 5, "Pending")])
    orders = orders.withColumn(
        "payment_method", F.when(F.col("order_id") == 0, "Upi").otherwise(F.col("payment_method"))
    )
    reviews = spark.createDataFrame([(1, 1, 0, 4, "t", DAY)], STAR["reviews"])
    marketing = spark.createDataFrame([], STAR["marketing_campaigns"])
    return churn.churn_features(customers, orders, reviews, marketing)


def test_churn_features(spark):
    got = {r["customer_id"]: r for r in _features(spark).collect()}
    assert set(got) == {1, 2}  # only customers with a Delivered order
    assert got[1]["churned"] == 1 and got[2]["churned"] == 0
    assert got[1]["preferred_payment_method"] == "Cod"  # tie: first by name
    assert got[1]["avg_order_value"] == 15.0 and got[1]["avg_rating"] == 4.0
    assert (got[2]["avg_rating"], got[2]["campaigns_targeted"]) == (0.0, 0)


def test_one_hot_equals_pandas_and_aligns(spark):
    features = _features(spark).withColumn(
        "gender", F.when(F.col("customer_id") == 1, F.lit(None).cast("string")).otherwise("Male")
    ).withColumn("city", F.when(F.col("customer_id") == 1, "A.b c").otherwise("Z"))
    levels = churn.category_levels(features)
    matrix = churn.one_hot(features, levels)
    dummies = pd.get_dummies(features.toPandas(), columns=churn.CATEGORICAL, drop_first=True)
    want = [c for c in dummies if any(c.startswith(f"{x}_") for x in churn.CATEGORICAL)]
    assert [c for c in matrix.columns if c not in (*churn.NUMERIC, "customer_id", "churned")] == want
    assert matrix.columns[2:14] == churn.NUMERIC
    aligned = churn.align(matrix, ["city_Z", "city_Gone", "age"])
    assert aligned.columns == ["customer_id", "churned", "city_Z", "city_Gone", "age"]
    assert rows(aligned) == [(1, 1, 0, 0, 30), (2, 0, 1, 0, 30)]


@pytest.mark.parametrize("hot", [0.5, 0.97])
def test_split_is_exact_per_label(spark, hot):
    df = spark.range(3000).select(
        F.col("id").alias("customer_id"), (F.col("id") >= int(3000 * hot)).cast("int").alias("churned")
    )
    got = churn.stratified_split(df).toPandas()
    assert len(got) == 3000
    shares = got.groupby("churned")["is_test"].agg(["sum", "size"])
    assert (shares["sum"] == (shares["size"] * 0.2).round()).all()
    again = churn.stratified_split(df.repartition(7)).toPandas()
    assert set(got[got["is_test"] == 1]["customer_id"]) == set(
        again[again["is_test"] == 1]["customer_id"]
    )


def test_scaling_leaves_constants_centred(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (5.0, 4.0)], "a double, b double")
    got = churn.scale_features(df, df.where("a < 5"), ["a", "b"]).toPandas()
    assert list(got["a"]) == [-1.0, 1.0, 3.0] and set(got["b"]) == {0.0}


def test_metrics_and_their_zero_divisions(spark):
    scored = spark.createDataFrame(
        [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (0, 0.6)], "label int, score double"
    )
    got = classification.classification_metrics(scored).first()
    assert got["precision"] == 0.5 and got["recall"] == 0.5 and got["accuracy"] == 0.6
    assert got["roc_auc"] == pytest.approx((3 + 1.5) / 6)
    low = scored.withColumn("score", F.lit(0.1))
    none = classification.classification_metrics(low).first()
    assert (none["precision"], none["f1"], none["roc_auc"]) == (0.0, 0.0, 0.5)
    assert rows(classification.confusion_matrix(low)) == [(0, 0, 3), (0, 1, 0), (1, 0, 2), (1, 1, 0)]
    assert classification.classification_metrics(scored.where("label = 1")).first()["roc_auc"] is None


def test_best_model_prefers_the_forest_on_a_tie(spark):
    both = [("Logistic Regression", 1, 0.9), ("Random Forest", 1, 0.8)]
    schema = "model string, label int, score double"
    pick = lambda data: classification.select_best_model(
        spark.createDataFrame(data, schema), models.FOREST
    ).first()["best_model"]
    assert pick(both) == "Random Forest"
    assert pick([*both, ("Random Forest", 1, 0.1)]) == "Logistic Regression"


def test_risk_levels_and_id_filter(spark):
    df = spark.createDataFrame([(p,) for p in (0.7, 0.69, 0.4, 0.39)], "p double")
    levels = [r[0] for r in df.select(models.risk_level(F.col("p"))).collect()]
    assert levels == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_models_find_a_planted_signal(spark, tmp_path):
    base = spark.range(400).select(
        F.col("id").alias("customer_id"),
        F.concat(F.lit("n"), "id").alias("customer_name"),
        (F.col("id") % 4 == 0).cast("int").alias("churned"),
        F.lit("x").alias("gender"), F.lit("x").alias("city"),
        F.lit("x").alias("customer_segment"), F.lit("x").alias("preferred_payment_method"),
    )
    noise = {c: (F.col("customer_id") * (7 + i) % 13).cast("double")
             for i, c in enumerate(churn.NUMERIC)}
    features = base.withColumns({**noise, "avg_rating": F.col("churned") * 3.0 + noise["avg_rating"] / 13})
    rows_, columns, levels = models.split_input(features)
    train, test = rows_.where("is_test = 0"), rows_.where("is_test = 1")
    for fit in (models.fit_logistic, lambda df: models.fit_forest(df, columns, f"{tmp_path}/f", trees=20)):
        model = fit(train)
        scored = models.score(model, test).withColumnRenamed("churned", "label")
        metrics = classification.classification_metrics(scored, score="churn_probability").first()
        assert metrics["recall"] > 0.9 and metrics["roc_auc"] > 0.95
    trained = models.Trained(models.FOREST, model, columns, levels)
    models.save(spark, trained, f"{tmp_path}/m")
    copy = models.load(spark, f"{tmp_path}/m")
    assert (copy.columns, copy.levels) == (columns, levels)
    everyone = rows(models.churn_predictions(features, copy))
    assert everyone == rows(models.churn_predictions(features, trained, customer_ids=[]))
    assert models.churn_predictions(features, trained, customer_ids=[3, 8]).count() == 2
    top = models.feature_importance(spark, copy).first()
    assert top["feature"] == "avg_rating"


# ---- daily series


def test_daily_metrics_fill_only_absent_days(spark):
    orders = make_orders(spark, [(1, 0, 10, D), (1, 0, 4, "Returned"), (1, 3, 9, "Cancelled")])
    got = [tuple(r)[1:] for r in daily.daily_metrics(orders).orderBy("order_date").collect()]
    assert got == [(10.0, 2, 3.0, 0.5), (0, 0, 0, 0), (0, 0, 0, 0), (None, 1, None, 1.0)]
    filled = daily.daily_metrics(orders, fill_observed=True).orderBy("order_date").collect()
    assert tuple(filled[-1])[1:] == (0.0, 1, 0.0, 1.0)


def test_revenue_series_keeps_its_sum_and_has_no_gap(spark):
    orders = make_orders(spark, [(1, d, 5, D) for d in (0, 0, 40, 90)])
    got = daily.daily_revenue_filled(orders).toPandas().sort_values("ds")
    assert len(got) == 91 and got["y"].sum() == 20
    series = make_orders(spark, [(1, 0, 5, D), (2, 3, 5, D), (2, 5, 5, D)])
    per = daily.daily_revenue_filled(series, ["customer_id"]).toPandas()
    assert per.groupby("customer_id").size().to_dict() == {1: 1, 2: 3}


def test_zscore_classes(spark):
    base = [(DAY + dt.timedelta(days=i), 10.0 + i % 2) for i in range(60)]
    spike = [(DAY + dt.timedelta(days=60), 100.0), (DAY + dt.timedelta(days=61), None)]
    df = spark.createDataFrame([*base, *spike], "order_date date, daily_revenue double")
    got = anomaly.zscore_anomalies(df, ["daily_revenue"]).orderBy("order_date").collect()
    assert [r["daily_revenue_anomaly"] for r in got[58:]] == ["Normal", "Normal", "HIGH", "Normal"]
    alerts = anomaly.anomaly_alerts(df.sparkSession.createDataFrame(got)).collect()
    assert len(alerts) == 1 and alerts[0]["metric"] == "Daily Revenue"
    constant = anomaly.zscore_anomalies(
        df.withColumn("daily_revenue", F.lit(1.0)), ["daily_revenue"]
    )
    assert constant.where("daily_revenue_anomaly <> 'Normal'").count() == 0
    check = lambda month: anomaly.known_anomaly_check(
        df.sparkSession.createDataFrame(got), 2024, month, "daily_revenue_anomaly", ["HIGH"]
    ).first()["caught"]
    assert check(3) is True and check(1) is False and check(7) is False


def test_isolation_forest_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": range(1500), "a": rng.normal(size=1500), "b": rng.normal(size=1500)})
    pdf.loc[[7, 900], ["a", "b"]] = [[9.0, -9.0], [-8.0, 8.0]]
    df = spark.createDataFrame(pdf)
    scores = [
        isolation_forest.isolation_scores(df.repartition(n), "k", ["a", "b"], trees=40)
        .toPandas().sort_values("k")["score"].to_numpy()
        for n in (1, 6)
    ]
    assert (scores[0] == scores[1]).all()
    assert set(np.argsort(scores[0])[-2:]) == {7, 900}
    frame = spark.createDataFrame(pd.DataFrame({"k": range(1500), "score": scores[0]}))
    flags = isolation_forest.isolation_flags(df, frame, "k", contamination=0.05).toPandas()
    assert (flags["isolation_forest_flag"] == "Anomaly").sum() == 75
    assert isolation_forest.isolation_scores(df.where("false"), "k", ["a"]).count() == 0


# ---- forecasting


def _series(spark, y, name="s"):
    data = [(name, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(data, "series string, ds date, y double")


def test_split_and_baseline(spark):
    df = _series(spark, range(100))
    split = forecast.holdout_split(df, 60, ["series"])
    assert split.where("part = 'test'").count() == 60
    base = forecast.baseline_forecast(split, 7, ["series"]).toPandas()
    assert len(base) == 60 and set(base["yhat"]) == {36.0}
    scores = forecast.forecast_metrics(spark.createDataFrame(base)).first()
    error = base["y"] - base["yhat"]
    assert scores["mae"] == pytest.approx(error.abs().mean())
    assert scores["rmse"] == pytest.approx((error**2).mean() ** 0.5)


def test_mape_leaves_out_zero_days(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "y double, yhat double")
    got = forecast.forecast_metrics(df).first()
    assert (got["mae"], got["mape"]) == (5.0, 50.0)


def test_seasonal_model_follows_trend_and_week(spark):
    days = np.arange(800)
    y = 100 + 0.1 * days + 20 * (days % 7 == 5)
    both = _series(spark, y).unionByName(_series(spark, [1.0, 2.0, 3.0], "short"))
    ahead = forecast.seasonal_forecast(both, ["series"], 30).toPandas()
    long = ahead[ahead["series"] == "s"].sort_values("ds")
    future = np.arange(800, 830)
    want = 100 + 0.1 * future + 20 * (future % 7 == 5)
    assert np.abs(long["yhat"] - want).mean() < 6
    assert (long["yhat_lower"] <= long["yhat"]).all()
    short = ahead[ahead["series"] == "short"]["yhat"]  # 1, 2, 3: goes on by the same formula
    assert short.notna().all() and short.iloc[0] > 2.0
    split = forecast.holdout_split(_series(spark, y), 60, ["series"])
    seasonal = forecast.seasonal_holdout_forecast(split, ["series"])
    naive = forecast.baseline_forecast(split, 7, ["series"])
    rmse = [forecast.forecast_metrics(f).first()["rmse"] for f in (seasonal, naive)]
    assert rmse[0] < rmse[1]


@pytest.mark.parametrize("n", [1, 2, 13, 14])
def test_one_formula_for_short_series(n):
    day = np.arange(20000.0, 20000.0 + n)
    rising = 100 + 10 * np.arange(n)
    yhat, residual = forecast._predict(day, rising.astype(float), day[-1] + np.arange(1, 4))
    assert np.isfinite(yhat).all() and residual >= 0
    if n == 1:
        assert np.abs(yhat - 100).max() < 60  # the level, but for what a wave may hold
    if n >= 13:
        assert (yhat > rising.mean()).all()


def test_thirteen_and_fourteen_days_agree():
    day = np.arange(20000.0, 20014.0)
    y = 100 + 10 * np.arange(14.0)
    a, _ = forecast._predict(day[:13], y[:13], day[13:])
    b, _ = forecast._predict(day, y, day[13:])
    assert abs(a[0] - b[0]) < 40


def _wavering(seed, n=700, horizon=90):
    """A series whose slope changes now and then, also after its history."""
    draw = np.random.default_rng(seed)
    changes = np.where(draw.random(n + horizon) < 0.02, draw.laplace(0, 0.15, n + horizon), 0)
    days = np.arange(n + horizon)
    return 500 + np.cumsum(0.1 + np.cumsum(changes)) + 10 * (days % 7 == 2) + draw.normal(0, 8, n + horizon)


@pytest.mark.parametrize("seed", range(6))
def test_the_fit_is_the_optimum_and_sparse(seed):
    y = _wavering(seed)[:700]
    fit = forecast._fit(np.arange(20000.0, 20700.0), y)
    assert fit["violation"] < 1e-8
    changes = fit["beta"][2 : 2 + forecast.CHANGE_POINTS]
    assert 0 < np.count_nonzero(changes) < forecast.CHANGE_POINTS
    steady = forecast._fit(np.arange(20000.0, 20700.0), 100 + np.random.default_rng(seed).normal(0, 5, 700))
    assert np.count_nonzero(steady["beta"][2 : 2 + forecast.CHANGE_POINTS]) <= 3 and steady["violation"] < 1e-8


def test_intervals_widen_and_cover(spark):
    inside, widths, n = [], [], 1500
    points = (np.linspace(0, 0.8, forecast.CHANGE_POINTS + 1)[1:] * (n - 1)).astype(int)
    for seed in range(20):
        # slopes change as the model has it: at its points, and as often afterwards
        draw, days = np.random.default_rng(seed), np.arange(n + 90)
        changes = np.zeros(n + 90)
        changes[points] = draw.laplace(0, 0.1, len(points))
        changes[n:] = np.where(draw.random(90) < len(points) / n, draw.laplace(0, 0.1, 90), 0)
        y = 500 + np.cumsum(np.cumsum(changes)) + 10 * (days % 7 == 2) + draw.normal(0, 8, n + 90)
        fit = forecast._fit(20000.0 + np.arange(n), y[:n])
        yhat = forecast._values(fit, 20000.0 + n + np.arange(90))
        low, high = forecast._bounds(fit, 90, seed)
        inside.append(((yhat + low <= y[n:]) & (y[n:] <= yhat + high)).mean())
        widths.append((high - low)[[0, 44, 89]])
    first, middle, last = np.mean(widths, axis=0)
    assert first < middle < last
    assert 0.65 < np.mean(inside) < 0.95


def test_stored_fits_predict_without_the_history(spark, tmp_path):
    both = _series(spark, _wavering(1)[:400]).unionByName(_series(spark, [1.0, 2.0, 3.0], "short"))
    fits = forecast.fit_forecasts(both, ["series"])
    fits.write.parquet(f"{tmp_path}/fits")
    stored = spark.read.parquet(f"{tmp_path}/fits")
    assert rows(forecast.predict_forecasts(stored, ["series"], 10)) == rows(forecast.seasonal_forecast(both, ["series"], 10))
    newer = stored.withColumn("format", F.lit(99))
    with pytest.raises(Exception, match="format 99"):
        forecast.predict_forecasts(newer, ["series"]).collect()
    assert forecast.fit_forecasts(both.limit(0), ["series"]).collect() == []


def test_series_shorter_than_the_holdout(spark):
    split = forecast.holdout_split(_series(spark, range(10)), 60, ["series"])
    got = forecast.seasonal_holdout_forecast(split, ["series"])
    assert got.count() == got.where("yhat IS NULL").count() == 10


# ---- review text


def _reviews(spark, texts, rating=5):
    data = [(i, i, i, rating, t, DAY) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, STAR["reviews"])


def test_topics_match_inside_words_in_order(spark):
    reviews = _reviews(spark, ["Unhelpful CHOCOLATE", "refund the price", "nothing here", None])
    got = [r["topics"] for r in
           reviews.select("review_id", sentiment.topic_tags(F.col("review_text")).alias("topics"))
           .orderBy("review_id").collect()]
    assert got == ["Delivery, Customer Service", "Pricing, Payment", "General", "General"]


def test_label_limits(spark):
    df = spark.createDataFrame([(s,) for s in (0.05, 0.0499, -0.05, -0.0499)], "s double")
    got = [r[0] for r in df.select(sentiment.sentiment_label(F.col("s"))).collect()]
    assert got == ["Positive", "Neutral", "Negative", "Neutral"]


def test_crosstab_and_topics_of_negative_reviews(spark):
    scored = sentiment.review_sentiment(_reviews(spark, ["good", "bad late refund", "bad box"], 5))
    assert rows(sentiment.rating_sentiment_crosstab(scored)) == [(5, 2, 0, 1)]
    assert rows(sentiment.negative_topic_counts(scored)) == [
        ("Delivery", 1), ("General", 1), ("Payment", 1)]
    assert sentiment.sentiment_agreement(scored).first()[0] == pytest.approx(1 / 3)


def test_link_drops_customers_without_reviews_or_orders(spark):
    scored = spark.createDataFrame(
        [(1, 0.5), (1, -0.1), (2, 0.2), (9, 0.9)], "customer_id int, sentiment_score double"
    )
    table = spark.createDataFrame(
        [(1, "A", 10.0, 1, 91), (2, "B", 20.0, 2, 90), (3, "B", 5.0, 1, 1)],
        "customer_id int, segment string, monetary double, frequency int, recency_days int",
    )
    link = sentiment.sentiment_business_link(scored, table)
    got = {r["customer_id"]: (round(r["avg_sentiment_score"], 6), r["churned"])
           for r in link.collect()}
    assert got == {1: (0.2, 1), 2: (0.2, 0)}
    groups = {(r["dimension"], r["value"]) for r in sentiment.sentiment_by_group(link).collect()}
    assert groups == {("segment", "A"), ("segment", "B"), ("churned", "0"), ("churned", "1")}
    assert sentiment.sentiment_correlations(link).first()["corr_frequency"] is None  # constant


# ---- exploration


@pytest.mark.parametrize("values", [[1, 2, 2, 3, 10], [5, 5, 5], list(range(100))])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = explore.numeric_histogram(df, "x", 10).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, bins=10)
    assert list(got["n"]) == list(counts)
    assert np.allclose(got["low"], edges[:-1]) and np.allclose(got["high"], edges[1:])


def test_histogram_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert explore.numeric_histogram(empty, "x", 10).count() == 0


def test_density_integrates_to_almost_one(spark):
    values = np.random.default_rng(1).normal(size=500).round(3)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    curve = explore.density_curve(df, "x").orderBy("point").toPandas()
    assert len(curve) == 200
    assert 0.9 < np.trapezoid(curve["density"], curve["x"]) <= 1.0


def test_tukey(spark):
    df = spark.createDataFrame([(float(v), 1) for v in [*range(1, 10), 100]], "x double, y int")
    got = {r["metric"]: r for r in explore.tukey_outliers(df, {"x": False, "y": True}).collect()}
    assert (got["x"]["high_whisker"], got["x"]["n_outliers"]) == (9.0, 1)
    assert got["y"]["n_outliers"] == 0


def test_correlations_are_pairwise(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 9], "b": [2.0, 1, None, 5, 3], "c": [1.0] * 5})
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = {(r["x"], r["y"]): r["r"] for r in explore.correlation_matrix(df, list("abc")).collect()}
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert got["a", "a"] == pytest.approx(1) and got["a", "c"] is None


def test_orders_per_customer_stats_equal_describe(spark):
    orders = make_orders(spark, [(c, 0, 1, D) for c in (1, 1, 1, 2, 3, 3, 4)])
    got = explore.orders_per_customer_stats(orders).first()
    want = pd.Series([3, 1, 2, 1]).describe()
    assert [got[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == (
        pytest.approx(list(want))
    )


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows(explore.null_counts(df, "t")) == [("t", "a", 1), ("t", "b", 2)]
