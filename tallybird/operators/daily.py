"""Daily business series on a complete calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.dates import calendar
from tallybird.functions.money import exact_mean
from tallybird.operators.business import DELIVERED, delivered

# Metric names and the states that count as lost orders.
METRICS = ["daily_revenue", "daily_orders", "daily_avg_delivery_time", "daily_cancel_rate"]
LOST = ["Cancelled", "Returned"]


def daily_revenue_filled(orders: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """(series..., ds, y): Delivered revenue per day, 0 on days without any, optionally for
    several series at once, each from its own first to its own last day."""
    series = list(series)
    observed = (
        delivered(orders)
        .where(F.col("order_date").isNotNull())
        .groupBy(*series, F.col("order_date").alias("ds"))
        .agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("y"))
    )
    spine = calendar(observed, "ds", by=series)
    return spine.join(observed, [*series, "ds"], "left").select(
        *series, "ds", F.coalesce("y", F.lit(0)).cast("double").alias("y")
    )


def daily_metrics(orders: DataFrame, fill_observed: bool = False) -> DataFrame:
    """Revenue, order count, mean delivery time and cancel rate per day, in one pass.

    Days without any order get 0 everywhere. A day that has orders, none of them Delivered, keeps
    NULL revenue and delivery time unless ``fill_observed``.
    """
    arrived = F.col("status") == DELIVERED

    def when_arrived(value: Column) -> Column:
        return F.when(arrived, value)

    n_arrived = F.count(F.when(arrived, 1))
    revenue = F.coalesce(F.sum(when_arrived(F.col("revenue"))), F.lit(0)).cast("double")
    lost = F.count(F.when(F.col("status").isin(LOST), 1))
    observed = (
        orders.where(F.col("order_date").isNotNull())
        .groupBy("order_date")
        .agg(
            F.when(n_arrived > 0, revenue).alias("daily_revenue"),
            F.count(F.lit(1)).alias("daily_orders"),
            exact_mean(when_arrived(F.col("delivery_time"))).alias("daily_avg_delivery_time"),
            (lost / F.count(F.lit(1))).alias("daily_cancel_rate"),
        )
    )
    if fill_observed:
        observed = observed.na.fill(0, METRICS)
    absent = F.col("_seen").isNull()
    filled = {m: F.when(absent, F.lit(0)).otherwise(F.col(m)) for m in METRICS}
    return (
        calendar(observed, "order_date")
        .join(observed.withColumn("_seen", F.lit(True)), "order_date", "left")
        .withColumns(filled)
        .select("order_date", *METRICS)
    )
