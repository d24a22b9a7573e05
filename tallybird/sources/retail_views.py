"""Raw retail tables derived from the order-processing test tables.

Pure projections and one equi join; keys, dates and defects follow from integer arithmetic on
the source keys, so that any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Review texts by tone. Between them they name every topic, and hold a negation,
# a booster, an exclamation, a contrast and a text without a topic.
POSITIVE_TEXTS = [
    "Excellent quality and I am very happy with it!",
    "The parcel arrived early, great service and friendly support",
    "Good value for the money, I recommend it",
    "LOVE this, truly wonderful!!",
]
NEUTRAL_TEXTS = [
    "It does the job and nothing more",
    "The box was dull but the item is fine for its price",
    "Shipping took some days, payment went through",
]
NEGATIVE_TEXTS = [
    "Terrible, the item came broken and the delivery was late",
    "Not good, I want a refund because I was charged twice",
    "Staff were extremely unhelpful and the response was rude?? Bad",
    "Poor and useless, a very disappointing chocolate box",
]


COPY = "_copy"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _with_copies(df: DataFrame, key: str, every: int) -> DataFrame:
    """Repeat each ``every``-th row: the duplicates that cleaning must remove. ``COPY`` numbers them."""
    copies = F.when(F.col(key) % every == 0, 2).otherwise(1)
    return df.withColumn(COPY, F.explode(F.sequence(F.lit(1), copies)))


def raw_customers(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    rows = customers.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.expr("CASE WHEN c_custkey % 33 = 7 THEN NULL ELSE CAST(18 + c_custkey % 47 AS INT) END")
        .alias("age"),
        F.expr(
            "CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Male' "
            "ELSE 'Female' END"
        ).alias("gender"),
        F.expr(
            "CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN upper(n_name) "
            "WHEN 2 THEN concat('  ', n_name, '  ') ELSE n_name END"
        ).alias("city"),
        F.expr(
            "CAST(date_add(DATE '1995-01-01', CAST((c_custkey * 37) % 2000 AS INT)) AS STRING)"
        ).alias("signup_date"),
        F.col("c_mktsegment").alias("customer_segment"),
    )
    return _with_copies(rows, "customer_id", 100).drop(COPY)


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.expr("round(p_retailprice / (1.2D + 0.1D * (p_partkey % 7)), 2)").alias("cost"),
        F.col("p_retailprice").alias("selling_price"),
        F.expr(
            "CAST(CASE WHEN p_partkey % 20 = 9 THEN NULL WHEN p_partkey % 400 = 3 THEN -5 "
            "ELSE (p_partkey * 17) % 500 END AS INT)"
        ).alias("inventory"),
    )


def _single_orders(spark: SparkSession, folder: str) -> DataFrame:
    first_part = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_partkey").alias("product_id"))
    )
    day = "CAST(o_orderdate AS DATE)"
    orders = (
        table(spark, folder, "orders")
        .join(first_part, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(
            table(spark, folder, "part").select("p_partkey", "p_retailprice"),
            F.col("product_id") == F.col("p_partkey"),
        )
        .withColumn(
            "day",
            F.expr(
                f"CASE WHEN o_custkey % 20 < 3 AND {day} >= DATE '1998-04-17' "
                f"THEN date_add({day}, -1202) ELSE {day} END"
            ),
        )
    )
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        "product_id",
        F.col("day").cast("string").alias("order_date"),
        F.expr(
            "CAST(CASE WHEN o_orderkey % 1800 = 11 THEN -1 ELSE 1 + o_orderkey % 4 END AS INT)"
        ).alias("quantity"),
        F.expr(
            "CASE WHEN o_orderkey % 1800 = 23 THEN 0.0D "
            "WHEN year(day) = 2000 AND month(day) = 11 THEN round(p_retailprice * 1.6D, 2) "
            "ELSE p_retailprice END"
        ).alias("price"),
        F.expr(
            "CASE CAST(floor(o_orderkey / 7.0D) AS BIGINT) % 7 WHEN 3 THEN 0.05D "
            "WHEN 4 THEN 0.10D WHEN 5 THEN 0.15D WHEN 6 THEN 0.20D ELSE 0.0D END"
        ).alias("discount"),
        _payment_text().alias("payment_method"),
        F.expr("CASE WHEN o_orderkey % 25 = 5 THEN NULL ELSE CAST(1 + o_orderkey % 9 AS INT) END")
        .alias("delivery_time"),
        F.expr(
            "CASE o_orderkey % 7 WHEN 4 THEN 'Cancelled' WHEN 5 THEN 'Returned' "
            "WHEN 6 THEN 'Pending' ELSE 'Delivered' END"
        ).alias("status"),
    )


def _payment_text() -> Column:
    usual = F.expr(
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Credit Card' WHEN '2' THEN "
        "'Debit Card' WHEN '3' THEN 'UPI' WHEN '4' THEN 'Net Banking' ELSE 'COD' END"
    )
    style = F.col("o_orderkey") % 3
    return F.when(style == 0, F.lower(usual)).when(style == 1, F.upper(usual)).otherwise(usual)


def numbered_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The raw orders, copies numbered in ``COPY``: one table to write for orders and reviews."""
    return _with_copies(_single_orders(spark, folder), "order_id", 200)


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    return numbered_orders(spark, folder).drop(COPY)


def _text_of(texts: list[str]) -> Column:
    return F.element_at(
        F.lit(texts), (F.col("order_id") * 17 % len(texts) + 1).cast("int")
    )


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return reviews_of(_single_orders(spark, folder))


def reviews_of(single_orders: DataFrame) -> DataFrame:
    """The raw reviews of orders without copies."""
    rated = (
        single_orders.select("order_id", "customer_id", "order_date", "status")
        .where("status = 'Delivered' AND order_id % 5 < 2")
        .withColumn("h", F.expr("(order_id * 13) % 100"))
        .withColumn(
            "rating",
            F.expr(
                "CASE WHEN h < 7 THEN 1 WHEN h < 15 THEN 2 WHEN h < 30 THEN 3 "
                "WHEN h < 60 THEN 4 ELSE 5 END"
            ),
        )
    )
    text = (
        F.when(F.col("rating") >= 4, _text_of(POSITIVE_TEXTS))
        .when(F.col("rating") == 3, _text_of(NEUTRAL_TEXTS))
        .otherwise(_text_of(NEGATIVE_TEXTS))
    )
    return rated.select(
        F.col("order_id").alias("review_id"),
        "customer_id",
        "order_id",
        "rating",
        F.when(F.col("order_id") % 33 != 0, text).alias("review_text"),
        F.expr(
            "CAST(date_add(CAST(order_date AS DATE), CAST(2 + order_id % 13 AS INT)) AS STRING)"
        ).alias("review_date"),
    )


def raw_marketing(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("campaign_id"),
        F.col("user_id").alias("customer_id"),
        F.expr("concat('C', event_id % 6)").alias("campaign"),
        F.expr("CASE WHEN event_id % 25 = 4 THEN NULL ELSE value END").alias("spend"),
        F.expr("CAST(get_json_object(props, '$.k') AS INT)").alias("clicks"),
        F.expr("CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END").alias("conversion"),
    )


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "customers": raw_customers(spark, folder),
        "products": raw_products(spark, folder),
        "orders": raw_orders(spark, folder),
        "reviews": raw_reviews(spark, folder),
        "marketing": raw_marketing(spark, folder),
    }
