"""Every query by name: staged input -> operator -> plainly typed output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybird.functions.polarity import LEXICON, polarity_by_table
from tallybird.operators import categories
from tallybird.operators import (
    anomaly,
    business,
    classification,
    cleaning,
    daily,
    explore,
    forecast,
    quality,
    rfm,
    sentiment,
)
from tallybird.operators import churn_features as features
from tallybird.operators import churn_models as models
from tallybird.operators import isolation_forest as forest
from tallybird.operators.keyword_topics import keyword_topics
from tallybird.operators.forest_table import forest_checks
from tallybird.operators.logistic_newton import fit_newton, newton_probability
from tallybird.plans import churn_training as churn
from tallybird.plans.warehouse import (
    customer_rfm,
    faulty_orders,
    landing_zone,
    load_star_schema,
    review_sentiment,
    rfm_base,
    staged,
    staged_raw,
    star_schema,
)
from tallybird.schemas import RAW, STAR
from tallybird.sources import quarantine
from tallybird.sources.landing import read_csv, read_raw_text, validation_report
from tallybird.sources.retail_views import table
from tallybird.sources.sinks import append_if_empty, conform, export_csv, replace_table
from tallybird.sources.workspace import staging_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ANOMALOUS_MONTH = (2000, 11)  # prices of the derived orders are raised in this month
CORRELATED = ["quantity", "price", "discount", "delivery_time", "revenue"]


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_")] = fn
    return fn


def plain(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Integers as bigint, decimals as double, doubles rounded."""

    def column(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.DoubleType):
            col = F.round(col, by_column.get(field.name, digits))
        return col.alias(field.name)

    return df.select([column(f) for f in df.schema])


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema(spark, folder)["orders"]


def _rfm(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_segments(rfm.rfm_scores(rfm_base(spark, folder)))


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema(spark, folder)["reviews"]


def _link(spark: SparkSession, folder: str) -> DataFrame:
    return sentiment.sentiment_business_link(
        review_sentiment(spark, folder), customer_rfm(spark, folder)
    )


def _anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.zscore_anomalies(daily.daily_metrics(_orders(spark, folder)))


# ---- sources, validation, sinks


@_query
def ingest_validate(spark, folder):
    landing = landing_zone(spark, folder)
    return plain(validation_report({t: read_raw_text(spark, landing, t) for t in RAW}))


@_query
def quarantine_counts(spark, folder):
    """Spoilt orders split into accepted and rejected: all records, both parts, and each reason."""
    target = f"{staging_path(spark, folder)}/quarantined/orders"
    quarantine.split_raw(spark, faulty_orders(spark, folder), "orders", target)
    return plain(quarantine.quarantine_report(spark, target, "orders"))


@_query
def quarantine_accepted(spark, folder):
    """What is left of the spoilt orders, typed."""
    target = f"{staging_path(spark, folder)}/quarantined/orders_accepted"
    quarantine.split_raw(spark, faulty_orders(spark, folder), "orders", target)
    return plain(quarantine.accepted(spark, target, "orders"))


@_query
def load_append_if_empty(spark, folder):
    target = f"{staging_path(spark, folder)}/append_once"
    products = conform(cleaning.clean_products(staged_raw(spark, folder)["products"]),
                       STAR["products"])
    append_if_empty(spark, products, target)
    append_if_empty(spark, products, target)
    return plain(spark.read.schema(STAR["products"]).parquet(target))


@_query
def load_star_schema_(spark, folder):
    target = f"{staging_path(spark, folder)}/star"
    clean = cleaning.clean_all(staged_raw(spark, folder))
    return plain(load_star_schema(spark, clean, target))


@_query
def valid_reviews(spark, folder):
    raw = staged_raw(spark, folder)
    reviews = cleaning.clean_reviews(raw["reviews"])
    return plain(quality.valid_reviews(reviews, cleaning.clean_orders(raw["orders"])))


@_query
def key_violations(spark, folder):
    return plain(quality.key_violations(staged_raw(spark, folder)))


@_query
def replace_derived_table(spark, folder):
    target = f"{staging_path(spark, folder)}/replaced/customer_rfm"
    written = replace_table(_rfm(spark, folder), target)
    export_csv(written, f"{target}.csv")
    return plain(read_csv(spark, f"{target}.csv", written.schema))


# ---- cleaning


@_query
def clean_customers(spark, folder):
    return plain(cleaning.clean_customers(staged_raw(spark, folder)["customers"]))


@_query
def clean_products(spark, folder):
    return plain(cleaning.clean_products(staged_raw(spark, folder)["products"]))


@_query
def clean_orders(spark, folder):
    return plain(cleaning.clean_orders(staged_raw(spark, folder)["orders"]))


@_query
def clean_reviews(spark, folder):
    return plain(cleaning.clean_reviews(staged_raw(spark, folder)["reviews"]))


@_query
def clean_marketing(spark, folder):
    return plain(cleaning.clean_marketing(staged_raw(spark, folder)["marketing"]))


@_query
def cleaning_report(spark, folder):
    return plain(cleaning.cleaning_report(staged_raw(spark, folder)))


# ---- business questions


def _over_orders(fn: Callable[[DataFrame], DataFrame], name: str | None = None) -> None:
    QUERIES[name or fn.__name__] = lambda spark, folder: plain(fn(_orders(spark, folder)))


for _fn in (
    business.total_revenue,
    business.revenue_by_payment,
    business.frequent_payment_methods,
    business.order_tiers,
    business.above_average_orders,
    business.top_customers_ranked,
    business.running_revenue,
    business.product_monthly_change,
    business.monthly_retention,
    business.churn_risk_rules,
    explore.monthly_revenue,
    explore.orders_per_customer_stats,
    daily.daily_revenue_filled,
    daily.daily_metrics,
    rfm.rfm_base,
):
    _over_orders(_fn)
_over_orders(business.rolling_revenue, "rolling_revenue_7")


@_query
def top_products(spark, folder):
    star = star_schema(spark, folder)
    return plain(business.top_products(star["orders"], star["products"]))


@_query
def city_profit(spark, folder):
    star = star_schema(spark, folder)
    return plain(business.city_profit(star["orders"], star["customers"], star["products"]))


@_query
def campaign_roi(spark, folder):
    star = star_schema(spark, folder)
    return plain(business.campaign_roi(star["marketing_campaigns"], star["orders"]))


# ---- customer analytics


@_query
def rfm_scores(spark, folder):
    return plain(rfm.rfm_scores(rfm_base(spark, folder)))


@_query
def rfm_segments(spark, folder):
    return plain(_rfm(spark, folder))


@_query
def segment_counts(spark, folder):
    return plain(rfm.segment_counts(customer_rfm(spark, folder)))


@_query
def segment_avg_value(spark, folder):
    return plain(rfm.segment_avg_value(customer_rfm(spark, folder)), digits=4)


# ---- churn


@_query
def churn_features(spark, folder):
    return plain(churn.features_of(spark, folder), digits=9)


@_query
def churn_rate(spark, folder):
    return plain(features.churn_rate(churn.features_of(spark, folder)))


@_query
def one_hot_features(spark, folder):
    rows = churn.staged_features(spark, folder)
    return plain(features.one_hot(rows, features.category_levels(rows)))


# Columns as an earlier model may have known them: other order, one level that no longer occurs.
KNOWN_COLUMNS = ["gender_Male", "city_Nation_7", "city_Atlantis", "frequency", "monetary", "age"]


@_query
def align_features(spark, folder):
    rows = churn.staged_features(spark, folder)
    matrix = features.one_hot(rows, features.category_levels(rows))
    return plain(features.align(matrix, KNOWN_COLUMNS))


def _category_table(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "category_table",
                  lambda: categories.category_table(churn.staged_features(spark, folder)))


@_query
def category_table(spark, folder):
    return _category_table(spark, folder)


@_query
def sparse_features(spark, folder):
    """The model matrix as places that hold a 1, joined from the level table."""
    sparse = categories.sparse_features(churn.staged_features(spark, folder), _category_table(spark, folder))
    return plain(sparse.withColumn("places", F.array_join(F.col("places").cast("array<string>"), ",")))


@_query
def sparse_features_view(spark, folder):
    """The columns of ``align_features`` as a dense view of the sparse rows."""
    levels = _category_table(spark, folder)
    sparse = categories.sparse_features(churn.staged_features(spark, folder), levels)
    wanted = {"gender_Male": ("gender", "Male"), "city_Nation_7": ("city", "Nation_7"), "city_Atlantis": ("city", "Atlantis")}
    view = categories.dense_view(sparse, levels, wanted)
    return plain(view.select("customer_id", "churned", *KNOWN_COLUMNS))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return features.stratified_split(churn.staged_features(spark, folder))


@_query
def stratified_split(spark, folder):
    return plain(_split(spark, folder).select("customer_id", "churned", "is_test"))


@_query
def scale_features(spark, folder):
    rows = _split(spark, folder).select("customer_id", "is_test", *features.NUMERIC)
    return plain(features.scale_features(rows, rows.where("is_test = 0")))


@_query
def churn_logistic(spark, folder):
    return plain(churn.scored_test(spark, folder, models.LOGISTIC))


@_query
def churn_logistic_optimum(spark, folder):
    """Newton's fit on the training part: its rows and columns, whether the mean penalised gradient is
    longer than 1e-8, and how many test scores of the other fit are off by more than a hundredth."""
    levels = features.category_levels(churn.staged_features(spark, folder))
    matrix = features.one_hot(_split(spark, folder), levels, ("customer_id", "churned", "is_test"))
    rows = staged(spark, folder, "churn_matrix", lambda: matrix)
    columns = [c for c in rows.columns if c not in ("customer_id", "churned", "is_test")]
    model = fit_newton(rows.where("is_test = 0"), columns)
    ours = rows.where("is_test = 1").select("customer_id", newton_probability(model).alias("p"))
    both = ours.join(churn.scored_test(spark, folder, models.LOGISTIC), "customer_id")
    return both.agg(
        F.count("*").alias("n_test"),
        F.lit(len(columns)).cast("bigint").alias("n_columns"),
        F.lit(int(model.gradient > 1e-8)).cast("bigint").alias("n_beyond"),
        F.count_if(F.abs(F.col("p") - F.col("churn_probability")) > 0.01).alias("n_apart"),
    )


@_query
def churn_random_forest(spark, folder):
    return plain(churn.scored_test(spark, folder, models.FOREST))


def _arithmetic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores computed from the key, so that the metrics are checked apart from any model."""
    rows = churn.staged_features(spark, folder)
    model = F.explode(
        F.array(
            F.struct(F.lit(models.LOGISTIC).alias("model"), F.lit(7919).alias("factor")),
            F.struct(F.lit(models.FOREST).alias("model"), F.lit(104729).alias("factor")),
        )
    ).alias("m")
    return rows.select("customer_id", F.col("churned").alias("label"), model).select(
        "customer_id",
        "label",
        "m.model",
        (F.col("customer_id") * F.col("m.factor") % 101 / F.lit(100.0)).alias("score"),
    )


@_query
def classification_metrics(spark, folder):
    scored = _arithmetic_scores(spark, folder).where(F.col("model") == models.LOGISTIC)
    return plain(classification.classification_metrics(scored))


@_query
def confusion_matrix(spark, folder):
    scored = _arithmetic_scores(spark, folder).where(F.col("model") == models.LOGISTIC)
    return plain(classification.confusion_matrix(scored))


@_query
def select_best_model(spark, folder):
    scored = _arithmetic_scores(spark, folder)
    return plain(classification.select_best_model(scored, models.FOREST))


@_query
def fitted_classification_metrics(spark, folder):
    """Metrics of both fitted models on the test part."""
    scored = churn.fitted_scores(spark, folder)
    lines = [
        classification.classification_metrics(scored.where(F.col("model") == name)).select(F.lit(name).alias("model"), "*")
        for name in (models.LOGISTIC, models.FOREST)
    ]
    return plain(lines[0].unionByName(lines[1]))


@_query
def fitted_confusion_matrix(spark, folder):
    scored = churn.fitted_scores(spark, folder)
    lines = [
        classification.confusion_matrix(scored.where(F.col("model") == name)).select(F.lit(name).alias("model"), "*")
        for name in (models.LOGISTIC, models.FOREST)
    ]
    return plain(lines[0].unionByName(lines[1]))


@_query
def fitted_best_model(spark, folder):
    return plain(classification.select_best_model(churn.fitted_scores(spark, folder), models.FOREST))


@_query
def fitted_score_checks(spark, folder):
    """What can be said of the scores without fitting: rows by label, scores outside [0, 1]."""
    scored = churn.fitted_scores(spark, folder)
    return plain(
        scored.groupBy("model").agg(
            F.count("*").alias("n_rows"),
            F.sum("label").alias("n_churned"),
            F.count_if(~F.col("score").between(0, 1) | F.col("score").isNull()).alias("n_outside"),
        )
    )


@_query
def feature_importance(spark, folder):
    return plain(
        models.feature_importance(spark, churn.stored_model(spark, folder, models.FOREST))
    )


@_query
def forest_node_checks(spark, folder):
    """Trees, roots, split nodes whose children's draws do not add up to theirs, importances in sum."""
    return forest_checks(spark, churn.stored_model(spark, folder, models.FOREST).model)


@_query
def churn_predictions(spark, folder):
    def scored() -> DataFrame:
        trained = churn.best_model(spark, folder)
        return models.score_customers(churn.staged_features(spark, folder), trained)

    # written before it is sorted: a sort reads its input twice, which would score twice
    return plain(models.by_risk(staged(spark, folder, "churn_predictions", scored)))


def _roundtrip(spark: SparkSession, folder: str, name: str) -> DataFrame:
    trained = churn.stored_model(spark, folder, name)
    path = f"{staging_path(spark, folder)}/churn/roundtrip_{name.replace(' ', '_')}"
    models.save(spark, trained, path)
    copy = models.load(spark, path)
    rows = churn.staged_features(spark, folder)
    ours, theirs = (
        models.score(m.model, models.model_input(rows, m.levels, m.columns)) for m in (trained, copy)
    )
    both = ours.join(theirs.select("customer_id", F.col("churn_probability").alias("_p")),
                     "customer_id")
    difference = F.max(F.abs(F.col("churn_probability") - F.col("_p")))
    return both.agg(F.count("*").alias("num_scores"), difference.alias("max_difference")).select(
        F.lit(name).alias("model"), "*"
    )


def _forecast_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts of fresh fits against those of the stored ones, which need no history."""
    stored = forecast.predict_forecasts(_forecast_fits(spark, folder), ["series"])
    fresh = forecast.seasonal_forecast(_category_series(spark, folder), ["series"])
    both = fresh.alias("a").join(stored.alias("b"), ["series", "ds"])
    bounds = ("yhat", "yhat_lower", "yhat_upper")
    apart = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in bounds])
    return both.agg(F.count("*").alias("num_scores"), F.max(apart).alias("max_difference")).select(
        F.lit("Forecast").alias("model"), "*"
    )


@_query
def model_roundtrip(spark, folder):
    """Largest difference between the results of each fitted model and of its stored copy."""
    parts = [_roundtrip(spark, folder, n) for n in (models.LOGISTIC, models.FOREST)]
    return plain(parts[0].unionByName(parts[1]).unionByName(_forecast_roundtrip(spark, folder)))


@_query
def churn_prediction_checks(spark, folder):
    """Customers scored, scores outside [0, 1], risk levels that disagree with their score."""
    p = F.col("churn_probability")
    level = F.when(p >= 0.7, "HIGH").when(p >= 0.4, "MEDIUM").otherwise("LOW")
    return churn_predictions(spark, folder).agg(
        F.count("*").alias("n_customers"),
        F.count_if(~p.between(0, 1) | p.isNull()).alias("n_outside"),
        # the score is rounded for output, so levels are compared away from the limits
        F.count_if((F.col("risk_level") != level) & (F.abs(p - 0.7) > 1e-5) & (F.abs(p - 0.4) > 1e-5))
        .alias("n_wrong_level"),
    )


# ---- daily series and anomalies


@_query
def zscore_anomalies(spark, folder):
    return plain(_anomalies(spark, folder))


@_query
def anomaly_alerts(spark, folder):
    return plain(anomaly.anomaly_alerts(_anomalies(spark, folder)), digits=4)


def _forest_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The days and their scores are written first: trees, scores and cut-off all read them."""
    days = staged(spark, folder, "daily_metrics", lambda: daily.daily_metrics(_orders(spark, folder)))
    scores = staged(
        spark,
        folder,
        "isolation_scores",
        lambda: forest.isolation_scores(days, "order_date", daily.METRICS),
    )
    return forest.isolation_flags(days, scores, "order_date")


@_query
def isolation_forest(spark, folder):
    return plain(_forest_flags(spark, folder))


@_query
def isolation_forest_checks(spark, folder):
    """Days scored, and whether the days flagged are some and within the share asked for."""
    flagged = F.count_if(F.col("isolation_forest_flag") == forest.ANOMALY)
    most = F.ceil(F.count("*") * forest.CONTAMINATION)
    return _forest_flags(spark, folder).agg(
        F.count("*").alias("n_days"),
        ((flagged > 0) & (flagged <= most)).alias("share_kept"),
        F.count_if(~F.col("isolation_score").between(0, 1)).alias("n_outside"),
    )


@_query
def daily_anomalies(spark, folder):
    """One row per day: metrics, z-scores and their classes, isolation score and flag."""
    flags = _forest_flags(spark, folder).select("order_date", "isolation_score", "isolation_forest_flag")
    table_ = staged(spark, folder, "daily_anomalies", lambda: _anomalies(spark, folder).join(flags, "order_date", "left"))
    return plain(table_)


@_query
def known_anomaly_check(spark, folder):
    return anomaly.known_anomaly_check(
        _anomalies(spark, folder), *ANOMALOUS_MONTH, "daily_revenue_anomaly",
        [anomaly.MEDIUM, anomaly.HIGH],
    )


@_query
def known_anomaly_check_forest(spark, folder):
    return anomaly.known_anomaly_check(
        _forest_flags(spark, folder), *ANOMALOUS_MONTH, "isolation_forest_flag", [forest.ANOMALY]
    )


# ---- forecasting


def _revenue_split(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.holdout_split(daily.daily_revenue_filled(_orders(spark, folder)))


@_query
def holdout_split(spark, folder):
    return plain(_revenue_split(spark, folder))


@_query
def baseline_forecast(spark, folder):
    return plain(forecast.baseline_forecast(_revenue_split(spark, folder)))


@_query
def forecast_metrics(spark, folder):
    baseline = forecast.baseline_forecast(_revenue_split(spark, folder))
    return plain(forecast.forecast_metrics(baseline))


def _category_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily revenue in total and per product category. Orders are summed per product and day
    before the categories are looked up."""
    star = star_schema(spark, folder)
    per_product = (
        business.delivered(star["orders"])
        .groupBy("product_id", "order_date", "status")
        .agg(F.sum("revenue").alias("revenue"))
    )
    named = per_product.join(star["products"].select("product_id", "category"), "product_id")
    series = F.explode(F.array(F.lit("all"), F.coalesce("category", F.lit("none"))))
    return daily.daily_revenue_filled(named.withColumn("series", series), ["series"])


@_query
def seasonal_holdout_forecast(spark, folder):
    split = forecast.holdout_split(_category_series(spark, folder), series=["series"])
    return plain(forecast.seasonal_holdout_forecast(split, ["series"]))


def _forecast_fits(spark: SparkSession, folder: str) -> DataFrame:
    """The stored fits of all series."""
    return staged(spark, folder, "forecast_fits",
                  lambda: forecast.fit_forecasts(_category_series(spark, folder), ["series"]))


@_query
def forecast_90day(spark, folder):
    return plain(forecast.predict_forecasts(_forecast_fits(spark, folder), ["series"]))


@_query
def forecast_optimality(spark, folder):
    """Per series, whether its fit is the optimum: conditions off by more than 1e-8."""
    return _forecast_fits(spark, folder).select(
        "series", (F.col("violation") > 1e-8).cast("bigint").alias("n_violations")
    )


@_query
def forecast_widths(spark, folder):
    """Per series, days ahead, and whether the last one's interval is narrower than the first one's."""
    width = F.col("yhat_upper") - F.col("yhat_lower")
    ends = forecast_90day(spark, folder).groupBy("series").agg(
        F.count("*").alias("n_days"), F.min_by(width, "ds").alias("first"), F.max_by(width, "ds").alias("last")
    )
    narrower = (F.col("last") < F.col("first") - 1e-6).cast("bigint").alias("n_narrower")
    return ends.select("series", "n_days", narrower)


@_query
def forecast_model_metrics(spark, folder):
    """The seasonal fit and the baseline on the same holdout, per series."""
    split = forecast.holdout_split(_category_series(spark, folder), series=["series"])
    fits = {
        "baseline": forecast.baseline_forecast(split, series=["series"]),
        "seasonal": forecast.seasonal_holdout_forecast(split, ["series"]),
    }
    both = [df.select("series", "y", "yhat", F.lit(name).alias("model")) for name, df in fits.items()]
    return plain(forecast.forecast_metrics(both[0].unionByName(both[1]), ["series", "model"]))


@_query
def forecast_checks(spark, folder):
    """Per series: days ahead, first and last, and days whose bounds are out of order."""
    ahead = forecast.predict_forecasts(_forecast_fits(spark, folder), ["series"])
    ordered = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return plain(
        ahead.groupBy("series").agg(
            F.min("ds").alias("first_day"),
            F.max("ds").alias("last_day"),
            F.count("*").alias("n_days"),
            F.count_if(~ordered | ordered.isNull()).alias("n_unordered"),
        )
    )


# ---- review text


@_query
def sentiment_scores(spark, folder):
    scored = sentiment.sentiment_scores(_reviews(spark, folder))
    return plain(scored.select("review_id", "sentiment_score"))


@_query
def sentiment_scores_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return plain(sentiment.sentiment_scores(documents, "text").select("doc_id", "sentiment_score"))


@_query
def sentiment_scores_by_table(spark, folder):
    """The same scores with the lexicon as a table that is joined."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    entries = F.array(*[F.struct(F.lit(k).alias("token"), F.lit(v).alias("valence")) for k, v in LEXICON.items()])
    lexicon = spark.range(1).select(F.inline(entries))
    return plain(polarity_by_table(documents, lexicon).select("doc_id", "sentiment_score"))


@_query
def sentiment_labels(spark, folder):
    return sentiment.review_sentiment(_reviews(spark, folder)).select(
        "review_id", "sentiment_label"
    )


@_query
def review_topics(spark, folder):
    return _reviews(spark, folder).select(
        "review_id", sentiment.topic_tags(F.col("review_text")).alias("topics")
    )


def _tagged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Label and topics of every document, whole text; written once for the queries that read it."""

    def tagged() -> DataFrame:
        documents = table(spark, folder, "documents").select("doc_id", "text")
        return sentiment.sentiment_scores(documents, "text").select(
            "doc_id",
            sentiment.sentiment_label(F.col("sentiment_score")).alias("sentiment_label"),
            sentiment.topic_tags(F.col("text")).alias("topics"),
        )

    return staged(spark, folder, "tagged_documents", tagged)


@_query
def sentiment_labels_documents(spark, folder):
    return _tagged_documents(spark, folder).select("doc_id", "sentiment_label")


@_query
def topics_documents(spark, folder):
    return _tagged_documents(spark, folder).select("doc_id", "topics")


@_query
def keyword_topics_documents(spark, folder):
    """Topics by a keyword table: the fixed topics, and one whose keywords are the long words of all
    benchmark items."""
    fixed = [F.struct(F.lit(t).alias("topic"), F.lit(w).alias("keyword"), F.lit(k).alias("place"))
             for k, (t, words) in enumerate(sentiment.TOPICS.items()) for w in words]
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")
    long = table(spark, folder, "benchmark").select(F.lit("Benchmark").alias("topic"), words, F.lit(99).alias("place"))
    keywords = spark.range(1).select(F.inline(F.array(*fixed))).unionByName(long.where("length(keyword) > 7").distinct())
    documents = table(spark, folder, "documents").select("doc_id", "text")
    tagged = keyword_topics(documents, keywords)
    return tagged.select("doc_id", F.array_join("topics", sentiment.SEPARATOR).alias("topics"))


@_query
def negative_topic_counts_documents(spark, folder):
    return sentiment.negative_topic_counts(_tagged_documents(spark, folder))


@_query
def rating_sentiment(spark, folder):
    label = sentiment.rating_label(F.col("rating"))
    return _reviews(spark, folder).select("review_id", label.alias("rating_based_sentiment"))


def _over_scored(fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[fn.__name__] = lambda spark, folder: plain(fn(review_sentiment(spark, folder)))


for _fn in (
    sentiment.sentiment_agreement,
    sentiment.sentiment_distribution,
    sentiment.rating_sentiment_crosstab,
    sentiment.negative_topic_counts,
):
    _over_scored(_fn)


@_query
def sentiment_business_link(spark, folder):
    return plain(_link(spark, folder), avg_sentiment_score=10)


@_query
def sentiment_by_group(spark, folder):
    return plain(sentiment.sentiment_by_group(_link(spark, folder)))


@_query
def sentiment_correlations(spark, folder):
    return plain(sentiment.sentiment_correlations(_link(spark, folder)))


# ---- exploration


@_query
def null_counts(spark, folder):
    star, raw = star_schema(spark, folder), staged_raw(spark, folder)
    parts = [
        explore.null_counts(business.delivered(star["orders"]), "orders"),
        explore.null_counts(star["customers"], "customers"),
        explore.null_counts(raw["orders"], "raw_orders"),
        explore.null_counts(raw["customers"], "raw_customers"),
    ]
    return plain(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


@_query
def numeric_histogram(spark, folder):
    orders = _orders(spark, folder)
    revenue = explore.numeric_histogram(business.delivered(orders), "revenue", 40)
    counts = explore.numeric_histogram(
        explore.orders_per_customer(orders), "num_orders", 20, "orders_per_customer", digits=0
    )
    return plain(revenue.unionByName(counts))


@_query
def density_curve(spark, folder):
    curve = explore.density_curve(business.delivered(_orders(spark, folder)), "revenue")
    return plain(curve, density=10)


@_query
def tukey_outliers(spark, folder):
    orders = business.delivered(_orders(spark, folder))
    return plain(explore.tukey_outliers(orders, {"revenue": False, "delivery_time": True}))


@_query
def correlation_matrix(spark, folder):
    orders = business.delivered(_orders(spark, folder))
    return plain(explore.correlation_matrix(orders, CORRELATED))


@_query
def revenue_by_dimension(spark, folder):
    star = star_schema(spark, folder)
    return plain(
        explore.revenue_by_dimension(star["orders"], star["products"], star["customers"])
    )
