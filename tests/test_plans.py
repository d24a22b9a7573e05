"""Plan shapes that must hold at any size of the data."""

from __future__ import annotations

import pytest

from tallybird.functions.stats import exact_quantiles
from tallybird.operators import business, rfm
from tallybird.plans import warehouse
from tallybird.plans.registry import QUERIES
from tallybird.plans.warehouse import staged_raw, star_schema
from tallybird.sources import retail_views
from tallybird.sources.retail_views import raw_tables
from tallybird.sources.workspace import staging_path

# The only jobs that run Python on executors, and those whose input is a fitted model.
PYTHON = {"isolation_forest", "isolation_forest_checks", "daily_anomalies", "known_anomaly_check_forest",
          "seasonal_holdout_forecast", "forecast_90day", "forecast_checks", "forecast_model_metrics",
          "density_curve", "keyword_topics_documents", "forecast_widths"}
MODELS = {"churn_logistic", "churn_random_forest", "churn_predictions", "model_roundtrip",
          "feature_importance", "churn_logistic_optimum"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - MODELS))
def test_no_python_and_no_product_joins(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", sorted(PYTHON))
def test_python_comes_in_batches(spark, data_dir, name):
    assert "BatchEvalPython" not in plan(QUERIES[name](spark, data_dir))


def test_scans_are_filtered_and_pruned(spark, data_dir):
    orders = star_schema(spark, data_dir)["orders"]
    text = plan(business.total_revenue(orders))
    assert "EqualTo(status,Delivered)" in text
    assert "ReadSchema: struct<status:string,revenue:decimal(18,2)>" in text


def test_semi_and_anti_joins(spark, data_dir):
    assert "LeftSemi" in plan(QUERIES["valid_reviews"](spark, data_dir))
    assert "LeftAnti" in plan(QUERIES["key_violations"](spark, data_dir))


def test_the_ranking_sees_only_the_best(spark, data_dir):
    text = plan(business.top_customers_ranked(star_schema(spark, data_dir)["orders"]))
    window = text[text.index("Window"):]
    assert "TakeOrderedAndProject" in window  # below the window: at most k rows reach it


def test_fact_side_is_summed_before_it_is_joined(spark, data_dir):
    star = star_schema(spark, data_dir)
    text = plan(business.top_products(star["orders"], star["products"]))
    join = text[text.index("Join"):]
    assert "partial_sum(revenue" in join


def test_scores_do_not_rank_all_customers_at_once(spark, data_dir):
    scored = rfm.rfm_scores(rfm.rfm_base(star_schema(spark, data_dir)["orders"]))
    text = plan(scored)
    assert "row_number" not in text


@pytest.mark.parametrize("name", ["cleaning_report", "key_violations"])
def test_checks_read_the_written_raw_tables(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    assert "orderkey" not in text and "custkey" not in text  # columns of the tables they derive from


def test_the_report_groups_each_raw_table_once(spark, data_dir):
    report = QUERIES["cleaning_report"](spark, data_dir)
    text = plan(report)
    main = text.split("Subquery")[0]
    assert main.count("FileScan") == 5  # customers, products, orders, reviews, marketing
    assert report.groupBy("table_name", "check_name").count().where("count > 1").isEmpty()


def test_buckets_are_sought_by_value_and_not_by_row(spark):
    rows = spark.range(500).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x").dropDuplicates()
    text = plan(exact_quantiles(rows, "x", [0.5]))
    assert not [line for line in text.splitlines() if "Filter" in line and "aggregate(" in line]
    below = text[text.rindex("HashAggregate(keys=[id"):]  # the scan's side of the first shuffle
    assert "Filter" not in below


def test_orders_are_derived_once_for_orders_and_reviews(spark, tmp_path):
    day = "CAST('1998-05-01' AS TIMESTAMP_NTZ)"
    tables = {
        "nation": "1 AS n_nationkey, 'PERU' AS n_name",
        "customer": "id AS c_custkey, 1 AS c_nationkey, 'c' AS c_name, 'm' AS c_mktsegment",
        "part": "id AS p_partkey, 'b' AS p_brand, 't' AS p_type, 9.5D AS p_retailprice",
        # a key that comes twice
        "orders": f"id div 2 AS o_orderkey, id AS o_custkey, {day} AS o_orderdate, '1-URGENT' AS o_orderpriority",
        "lineitem": "id AS l_orderkey, id % 5 AS l_partkey",
        "events": "id AS event_id, id AS user_id, 'view' AS event_type, 1.5D AS value, '{\"k\":1}' AS props",
    }
    for name, columns in tables.items():
        n = 1 if name == "nation" else 900
        spark.range(n).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    want = raw_tables(spark, str(tmp_path))
    got = staged_raw(spark, str(tmp_path))
    for name in want:
        assert got[name].columns == want[name].columns
        assert got[name].exceptAll(want[name]).isEmpty() and want[name].exceptAll(got[name]).isEmpty()


def test_staged_reviews_read_the_written_orders(spark, data_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(warehouse, "reviews_of", lambda orders: seen.extend(orders.inputFiles()) or retail_views.reviews_of(orders))
    monkeypatch.setattr(warehouse, "staging_path", lambda s, f: f"{staging_path(s, f)}/again")
    staged_raw(spark, data_dir)
    assert seen and all("/raw/orders/" in file for file in seen)
