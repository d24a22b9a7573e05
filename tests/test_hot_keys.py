"""A third of all rows on one customer, product and value: results must equal brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tallybird.operators import business, churn_features, explore, rfm
from tallybird.schemas import STAR

N = 6000


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(11)
    hot = rng.random((3, N)) < 1 / 3
    orders = pd.DataFrame(
        {
            "order_id": np.arange(N),
            "customer_id": np.where(hot[0], 1, rng.integers(0, 400, N)),
            "product_id": np.where(hot[1], 2, rng.integers(0, 50, N)),
            "order_date": pd.Timestamp("2023-01-01") + pd.to_timedelta(rng.integers(0, 500, N), "D"),
            "quantity": rng.integers(1, 5, N),
            "discount": rng.integers(0, 3, N) / 10,
            "payment_method": np.where(hot[2], "Upi", rng.choice(["Cod", "Card", "Upi"], N)),
            "delivery_time": rng.integers(1, 9, N),
            "status": rng.choice(["Delivered", "Pending"], N, p=[0.8, 0.2]),
            "revenue": np.where(hot[2], 99.5, rng.integers(100, 900_000, N) / 100),
        }
    )
    orders["price"] = orders["revenue"]
    customers = pd.DataFrame({"customer_id": range(400)}).assign(
        city=lambda d: "c" + (d["customer_id"] % 7).astype(str)
    )
    products = pd.DataFrame({"product_id": range(50)}).assign(
        category=lambda d: "k" + (d["product_id"] % 5).astype(str),
        brand="b",
        cost=lambda d: d["product_id"] / 4,
    )
    return orders, customers, products


@pytest.fixture(scope="module")
def tables(spark, frames):
    orders, customers, products = frames
    typed = orders.assign(order_date=orders["order_date"].dt.date)

    def typed_table(pdf, schema):
        df = spark.createDataFrame(pdf)
        return df.select([df[f.name].cast(f.dataType) for f in schema if f.name in pdf])

    return (
        typed_table(typed, STAR["orders"]),
        typed_table(customers, STAR["customers"]),
        typed_table(products, STAR["products"]),
    )


@pytest.fixture(scope="module")
def sold(frames):
    orders, customers, products = frames
    kept = orders[orders["status"] == "Delivered"]
    return kept.merge(customers, on="customer_id").merge(products, on="product_id")


def test_city_profit(tables, sold):
    got = business.city_profit(*tables).toPandas().set_index("city").astype(float)
    spent = sold.assign(total_cost=sold["cost"] * sold["quantity"]).groupby("city")
    want = spent.agg(total_revenue=("revenue", "sum"), total_cost=("total_cost", "sum"))
    assert np.allclose(got.loc[want.index, want.columns], want)


def test_top_products_and_dimensions(tables, sold):
    orders, customers, products = tables
    got = business.top_products(orders, products).toPandas().set_index("category")
    want = sold.groupby("category")["revenue"].agg(["sum", "size"])
    assert np.allclose(got.loc[want.index, "total_revenue"].astype(float), want["sum"])
    assert (got.loc[want.index, "num_orders"] == want["size"]).all()
    both = explore.revenue_by_dimension(orders, products, customers).toPandas()
    totals = both.groupby("dimension")["total_revenue"].sum().astype(float)
    assert np.allclose(totals, sold["revenue"].sum())


def test_retention(tables, sold):
    got = business.monthly_retention(tables[0]).toPandas()
    seen = sold.assign(m=sold["order_date"].dt.to_period("M")).groupby("m")["customer_id"].agg(set)
    for row in got.itertuples():
        month = pd.Period(row.order_month, "M")
        before = seen.get(month - 1, set())
        assert row.active_customers == len(seen[month])
        assert row.retained_from_prev_month == len(seen[month] & before)
    assert len(got) == len(seen)


def test_scores(tables, sold):
    got = rfm.rfm_scores(rfm.rfm_base(tables[0])).toPandas().sort_values("customer_id")
    base = sold.groupby("customer_id").agg(n=("order_id", "count"), m=("revenue", "sum"))
    assert list(got["frequency"]) == list(base["n"])
    rank = base["n"].rank(method="first")
    assert list(got["f_score"]) == list(pd.qcut(rank, 5, labels=[1, 2, 3, 4, 5]).astype(int))
    assert list(got["m_score"]) == list(pd.qcut(base["m"], 5, labels=[1, 2, 3, 4, 5]).astype(int))


def test_behaviour(tables, sold):
    got = churn_features.order_behaviour(tables[0]).toPandas().set_index("customer_id")
    groups = sold.groupby("customer_id")
    usual = groups["payment_method"].agg(lambda x: x.mode()[0])
    assert (got.loc[usual.index, "preferred_payment_method"] == usual).all()
    assert np.allclose(got.loc[usual.index, "avg_delivery_time"], groups["delivery_time"].mean())
    assert np.allclose(got.loc[usual.index, "avg_discount_used"], groups["discount"].mean())


def test_box_and_histogram_with_a_hot_value(tables, sold):
    orders = business.delivered(tables[0])
    got = explore.tukey_outliers(orders, {"revenue": False}).first()
    quartiles = np.quantile(sold["revenue"], [0.25, 0.5, 0.75])
    assert np.allclose([got["q1"], got["median"], got["q3"]], quartiles)
    bins = explore.numeric_histogram(orders, "revenue", 40).toPandas()
    assert bins["n"].sum() == len(sold)
