"""Business questions over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallybird.functions.dates import month_of
from tallybird.functions.money import mean_money
from tallybird.functions.stats import one_row

# Order states and the limits of the value tiers and risk classes.
DELIVERED = "Delivered"
HIGH_VALUE, MEDIUM_VALUE = 5000, 1500
HIGH_RISK_DAYS, MEDIUM_RISK_DAYS = 120, 60


def delivered(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") == DELIVERED)


def total_revenue(orders: DataFrame) -> DataFrame:
    return delivered(orders).agg(F.sum("revenue").alias("total_revenue"))


def revenue_by_payment(orders: DataFrame) -> DataFrame:
    return (
        delivered(orders)
        .groupBy("payment_method")
        .agg(
            F.count(F.lit(1)).alias("num_orders"),
            F.sum("revenue").alias("total_revenue"),
            mean_money(F.col("revenue"), 2).alias("avg_order_value"),
        )
        .orderBy(F.desc_nulls_first("total_revenue"), "payment_method")
    )


def frequent_payment_methods(orders: DataFrame, more_than: int = 500) -> DataFrame:
    """Payment methods with more than ``more_than`` orders of any status."""
    return (
        orders.groupBy("payment_method")
        .agg(F.count(F.lit(1)).alias("num_orders"))
        .where(F.col("num_orders") > more_than)
        .orderBy(F.desc("num_orders"), "payment_method")
    )


def top_products(orders: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Best selling (category, brand) pairs. Orders are summed per product before the join, so a
    best seller is one row when it meets the product table."""
    per_product = (
        delivered(orders)
        .groupBy("product_id")
        .agg(F.sum("revenue").alias("_revenue"), F.count("order_id").alias("_orders"))
    )
    return (
        per_product.join(products.select("product_id", "category", "brand"), "product_id")
        .groupBy("category", "brand")
        .agg(F.sum("_revenue").alias("total_revenue"), F.sum("_orders").alias("num_orders"))
        .orderBy(F.desc_nulls_first("total_revenue"), "category", "brand")
        .limit(k)
    )


def order_tier(revenue: Column) -> Column:
    return (
        F.when(revenue >= HIGH_VALUE, "High Value")
        .when(revenue >= MEDIUM_VALUE, "Medium Value")
        .otherwise("Low Value")
    )


def order_tiers(orders: DataFrame) -> DataFrame:
    return delivered(orders).select(
        "order_id", "revenue", order_tier(F.col("revenue")).alias("order_tier")
    )


def above_average_orders(orders: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` largest Delivered orders above the mean; compared as revenue * n > sum, exactly."""
    rows = delivered(orders).select("customer_id", "order_id", "revenue")
    overall = one_row(rows, F.sum("revenue").alias("total"), F.count("revenue").alias("n"))
    return (
        rows.withColumn("_all", overall)
        .where(F.col("revenue") * F.col("_all.n") > F.col("_all.total"))
        .drop("_all")
        .orderBy(F.desc("revenue"), "order_id")
        .limit(k)
    )


def city_profit(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, cost of goods and their difference per city. Orders shrink to one row per
    (customer, product) and then per customer, so neither join sees a repeated hot key."""
    bought = (
        delivered(orders)
        .groupBy("customer_id", "product_id")
        .agg(F.sum("revenue").alias("_revenue"), F.sum("quantity").alias("_units"))
    )
    per_customer = (
        bought.join(products.select("product_id", "cost"), "product_id")
        .groupBy("customer_id")
        .agg(
            F.sum("_revenue").alias("_revenue"),
            F.sum((F.col("cost") * F.col("_units")).cast("decimal(28,2)")).alias("_cost"),
        )
    )
    return (
        per_customer.join(customers.select("customer_id", "city"), "customer_id")
        .groupBy("city")
        .agg(F.sum("_revenue").alias("total_revenue"), F.sum("_cost").alias("total_cost"))
        .withColumn("total_profit", F.col("total_revenue") - F.col("total_cost"))
        .orderBy(F.desc_nulls_first("total_profit"), "city")
    )


def top_customers_ranked(orders: DataFrame, k: int = 20) -> DataFrame:
    """Customers ranked by lifetime spend. The best ``k`` are found first (each task keeps ``k``
    rows) and only those are ranked: a rank depends on the rows above it, all of them kept."""
    spent = delivered(orders).groupBy("customer_id").agg(F.sum("revenue").alias("total_spent"))
    best = spent.orderBy(F.desc_nulls_first("total_spent"), "customer_id").limit(k)
    by_spend = Window.orderBy(F.desc_nulls_first("total_spent"))
    return best.withColumn("spend_rank", F.rank().over(by_spend)).orderBy(
        "spend_rank", "customer_id"
    )


def daily_revenue(orders: DataFrame) -> DataFrame:
    return delivered(orders).groupBy("order_date").agg(F.sum("revenue").alias("daily_revenue"))


def _by_day() -> WindowSpec:
    """Unpartitioned on purpose: it orders one row per calendar day, and the number of days does
    not grow with the number of orders."""
    return Window.orderBy(F.asc_nulls_last("order_date"))


def running_revenue(orders: DataFrame) -> DataFrame:
    return (
        daily_revenue(orders)
        .withColumn("running_total", F.sum("daily_revenue").over(_by_day()))
        .orderBy(F.asc_nulls_last("order_date"))
    )


def rolling_revenue(orders: DataFrame, rows: int = 7) -> DataFrame:
    """Mean over the current and the preceding ``rows - 1`` days that have orders."""
    frame = _by_day().rowsBetween(1 - rows, 0)
    total, days = F.sum("daily_revenue").over(frame), F.count("daily_revenue").over(frame)
    return (
        daily_revenue(orders)
        .withColumn("rolling_7day_avg", F.round(total / F.nullif(days, F.lit(0)), 2))
        .orderBy(F.asc_nulls_last("order_date"))
    )


def product_monthly_change(orders: DataFrame) -> DataFrame:
    """Revenue per product and month beside that of the product's previous month with sales."""
    monthly = (
        delivered(orders)
        .groupBy("product_id", month_of(F.col("order_date")).alias("month"))
        .agg(F.sum("revenue").alias("monthly_revenue"))
    )
    history = Window.partitionBy("product_id").orderBy(F.asc_nulls_last("month"))
    return (
        monthly.withColumn("prev_month_revenue", F.lag("monthly_revenue").over(history))
        .withColumn("change", F.col("monthly_revenue") - F.col("prev_month_revenue"))
        .orderBy("product_id", F.asc_nulls_last("month"))
    )


def monthly_retention(orders: DataFrame) -> DataFrame:
    """Active customers per month and how many of them were active in the month before.

    Instead of joining customer-months with themselves, each order marks its own month as active
    and the next one as preceded; the marks meet in one map-side combined aggregation.
    """
    month = month_of(F.col("order_date"))

    def mark(day: Column, active: Column, before: Column) -> Column:
        return F.struct(day.alias("order_month"), active.alias("active"), before.alias("before"))

    marks = F.array(
        mark(month, F.lit(True), F.lit(False)),
        mark(F.add_months(month, 1), F.lit(False), month.isNotNull()),
    )
    seen = (
        delivered(orders)
        .select("customer_id", F.inline(marks))
        .groupBy("customer_id", "order_month")
        .agg(F.max("active").alias("active"), F.max("before").alias("before"))
        .where("active")
    )
    known = F.col("customer_id").isNotNull()
    counts = seen.groupBy("order_month").agg(
        F.count(F.when(known, 1)).alias("active_customers"),
        F.count(F.when(known & F.col("before"), 1)).alias("retained_from_prev_month"),
    )
    share = F.lit(100).cast("decimal(20,0)") * F.col("retained_from_prev_month")
    share = share / F.nullif(F.col("active_customers"), F.lit(0))
    return counts.withColumn("retention_pct", F.round(share, 1)).orderBy(
        F.asc_nulls_last("order_month")
    )


def churn_risk(days: Column) -> Column:
    return (
        F.when(days > HIGH_RISK_DAYS, "High Risk")
        .when(days > MEDIUM_RISK_DAYS, "Medium Risk")
        .otherwise("Low Risk")
    )


def churn_risk_rules(orders: DataFrame) -> DataFrame:
    """Risk class from the days between a customer's last Delivered order and the last order of
    any status in the data."""
    last_day = orders.agg(F.max("order_date")).scalar()
    last_orders = (
        delivered(orders).groupBy("customer_id").agg(F.max("order_date").alias("last_order_date"))
    )
    return (
        last_orders.withColumn(
            "days_since_last_order", F.datediff(last_day, F.col("last_order_date"))
        )
        .withColumn("churn_risk", churn_risk(F.col("days_since_last_order")))
        .orderBy(F.desc_nulls_first("days_since_last_order"), "customer_id")
    )


def campaign_roi(marketing: DataFrame, orders: DataFrame) -> DataFrame:
    """Return on spend per campaign, where each touch counts once per Delivered order of its
    customer (and once if there is none).

    That multiplication is done with counts: touches are summed per (customer, campaign) and
    orders per customer, so the join has one order row per customer and never fans out.
    """
    touches = marketing.groupBy("customer_id", "campaign").agg(
        F.count(F.lit(1)).alias("_touches"),
        F.sum("spend").alias("_spend"),
        F.sum("conversion").alias("_conversions"),
        F.count(F.when(F.col("conversion") == 1, 1)).alias("_converted"),
    )
    bought = (
        delivered(orders)
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("_orders"), F.sum("revenue").alias("_revenue"))
    )
    times = F.coalesce("_orders", F.lit(1))
    # A sum over no value at all is NULL: every touch converted and none met a revenue.
    attributed = F.when(
        (F.col("_converted") < F.col("_touches")) | F.col("_revenue").isNotNull(),
        F.col("_converted") * F.coalesce("_revenue", F.lit(0)),
    )
    per_campaign = (
        touches.join(bought, "customer_id", "left")
        .groupBy("campaign")
        .agg(
            F.sum(F.col("_touches") * times).alias("total_touches"),
            F.sum((F.col("_spend") * times).cast("decimal(34,2)")).alias("total_spend"),
            F.sum(F.col("_conversions") * times).alias("total_conversions"),
            F.sum(attributed.cast("decimal(34,2)")).alias("attributed_revenue"),
        )
    )
    gain = F.col("attributed_revenue") - F.col("total_spend")
    return per_campaign.withColumn(
        "roi_pct", F.round(gain / F.nullif("total_spend", F.lit(0)) * 100, 1)
    ).orderBy(F.desc_nulls_first("roi_pct"), "campaign")
