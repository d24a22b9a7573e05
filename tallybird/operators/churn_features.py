"""Customer feature table for churn: label, behaviour, reviews and marketing exposure; and its
model matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybird.functions.stats import one_row
from tallybird.operators.business import delivered

# The churn limit and the model's input columns.
CHURN_AFTER_DAYS = 90
CATEGORICAL = ["gender", "city", "customer_segment", "preferred_payment_method"]
NUMERIC = [
    "age", "tenure_days", "frequency", "monetary", "avg_order_value", "avg_discount_used",
    "avg_delivery_time", "avg_rating", "review_count", "campaigns_targeted",
    "total_marketing_spend", "total_conversions",
]


def _total(name: str) -> list[Column]:
    return [F.sum(name).alias(f"_{name}_sum"), F.count(name).alias(f"_{name}_n")]


def _mean(name: str) -> Column:
    total, n = F.sum(f"_{name}_sum").cast("double"), F.sum(f"_{name}_n").cast("double")
    return F.try_divide(total, n)


def order_behaviour(orders: DataFrame) -> DataFrame:
    """Per customer: recency, frequency, monetary, averages and the usual payment method (the
    alphabetically first of equally frequent ones).

    One pass over the orders. They are summed per (customer, payment method) first, which finds
    the method counts and keeps even a customer with very many orders to a few rows.
    """
    rows = delivered(orders).where(F.col("customer_id").isNotNull())
    last_day = delivered(orders).agg(F.max("order_date")).scalar()
    per_method = rows.groupBy("customer_id", "payment_method").agg(
        F.count(F.lit(1)).alias("_times"),
        F.count("order_id").alias("_orders"),
        F.max("order_date").alias("_last"),
        *_total("revenue"),
        *_total("discount"),
        *_total("delivery_time"),
    )
    usual = F.min(
        F.when(
            F.col("payment_method").isNotNull(),
            F.struct((-F.col("_times")).alias("minus"), F.col("payment_method").alias("name")),
        )
    )
    return (
        per_method.groupBy("customer_id")
        .agg(
            F.max("_last").alias("_last"),
            F.sum("_orders").alias("frequency"),
            F.coalesce(F.sum("_revenue_sum").cast("double"), F.lit(0.0)).alias("monetary"),
            _mean("revenue").alias("avg_order_value"),
            _mean("discount").alias("avg_discount_used"),
            _mean("delivery_time").alias("avg_delivery_time"),
            usual.alias("_usual"),
        )
        .withColumn("recency_days", F.datediff(last_day, F.col("_last")) + 1)
        .withColumn("preferred_payment_method", F.coalesce("_usual.name", F.lit("Unknown")))
        .drop("_usual", "_last")
    )


def churned(recency: Column) -> Column:
    return (recency > CHURN_AFTER_DAYS).cast("int")


def churn_features(
    customers: DataFrame, orders: DataFrame, reviews: DataFrame, marketing: DataFrame
) -> DataFrame:
    """One row per customer with a Delivered order. Recency defines the label and is left out.

    All four sides are one row per customer and partitioned by customer before they are joined.
    """
    behaviour = order_behaviour(orders).withColumn("churned", churned(F.col("recency_days")))
    review_side = reviews.groupBy("customer_id").agg(
        F.avg("rating").alias("avg_rating"), F.count("review_id").alias("review_count")
    )
    marketing_side = marketing.groupBy("customer_id").agg(
        F.count("campaign_id").alias("campaigns_targeted"),
        F.sum("spend").cast("double").alias("total_marketing_spend"),
        F.sum("conversion").alias("total_conversions"),
    )
    zero_if_absent = [
        "avg_rating", "review_count", "campaigns_targeted", "total_marketing_spend",
        "total_conversions",
    ]
    return (
        customers.join(behaviour, "customer_id")
        .join(review_side, "customer_id", "left")
        .join(marketing_side, "customer_id", "left")
        .na.fill(0, zero_if_absent)
        .select(
            *customers.columns,
            "frequency", "monetary", "churned", "avg_order_value", "avg_discount_used",
            "avg_delivery_time", "preferred_payment_method", *zero_if_absent,
        )
    )


def churn_rate(features: DataFrame) -> DataFrame:
    """Rows (churned, num_customers, share) for both label values found."""
    everyone = features.agg(F.count("*")).scalar()
    return (
        features.groupBy("churned")
        .agg(F.count(F.lit(1)).alias("num_customers"))
        .withColumn("share", F.try_divide(F.col("num_customers").cast("double"), everyone))
    )


def category_levels(
    features: DataFrame, columns: Sequence[str] = CATEGORICAL
) -> dict[str, list[str]]:
    """Sorted levels per categorical column, any number of them. Each becomes a matrix column and
    is known to the driver, as in any one-hot matrix."""
    found = features.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()
    return {column: list(found[column]) for column in columns}


def dummy_columns(levels: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(matrix column, source column, level), without the first level of each column."""
    return [(f"{c}_{level}", c, level) for c, found in levels.items() for level in found[1:]]


def one_hot(
    features: DataFrame,
    levels: dict[str, list[str]],
    keep: Sequence[str] = ("customer_id", "churned"),
) -> DataFrame:
    """``keep``, the numeric columns, then a 0/1 column per level. A NULL sets none of them."""
    dummies = [
        F.coalesce((F.col(source) == level).cast("int"), F.lit(0)).alias(name)
        for name, source, level in dummy_columns(levels)
    ]
    return features.select(*keep, *NUMERIC, *dummies)


def align(
    matrix: DataFrame, trained: Sequence[str], keep: Sequence[str] = ("customer_id", "churned")
) -> DataFrame:
    """The matrix with exactly the trained columns in the trained order: absent ones are 0, new
    ones are dropped."""
    present = set(matrix.columns)
    columns = [F.col(f"`{c}`") if c in present else F.lit(0).alias(c) for c in trained]
    return matrix.select(*keep, *columns)


# Modulus and multiplier of the minimal-standard generator (Park & Miller 1988).
_MODULUS, _MULTIPLIER = 2147483647, 48271
_SPLIT_BUCKETS = 1024


def mix(key: Column, seed: int) -> Column:
    """Integer hash in [0, 2^31 - 1), plain arithmetic so that any engine gives the same."""
    return F.pmod(F.pmod(key + seed, F.lit(_MODULUS)) * _MULTIPLIER, F.lit(_MODULUS))


def stratified_split(
    df: DataFrame,
    label: str = "churned",
    key: str = "customer_id",
    test_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``is_test``: exactly round(share * n) rows of each label, those with the least hash.

    A label holds up to all rows, so it is never ordered as one group: hashes are uniform, equal
    ranges of them are equal pieces of work, and range totals chain them.
    """
    hashed = df.withColumn("_hash", mix(F.col(key).cast("bigint"), seed)).withColumn(
        "_range", F.floor(F.col("_hash") / (_MODULUS / _SPLIT_BUCKETS + 1))
    )
    chain = Window.partitionBy(label).orderBy("_range")
    ranges = (
        hashed.groupBy(label, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            label,
            "_range",
            (F.sum("_n").over(chain) - F.col("_n")).alias("_before"),
            F.round(F.sum("_n").over(Window.partitionBy(label)) * test_share).alias("_wanted"),
        )
    )
    within = Window.partitionBy(label, "_range").orderBy("_hash", key)
    return (
        hashed.withColumn("_row", F.row_number().over(within))
        .join(ranges, [label, "_range"])
        .withColumn("is_test", (F.col("_before") + F.col("_row") <= F.col("_wanted")).cast("int"))
        .select(*df.columns, "is_test")
    )


def scale_features(
    df: DataFrame, train: DataFrame, columns: Sequence[str] = NUMERIC
) -> DataFrame:
    """Centre and scale ``columns`` of ``df`` by mean and population deviation of ``train``;
    a constant column is only centred."""
    fit = one_row(
        train,
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    )
    scaled = {
        c: (F.col(c) - F.col(f"_fit.{c}_mean"))
        / F.coalesce(F.nullif(F.col(f"_fit.{c}_std"), F.lit(0.0)), F.lit(1.0))
        for c in columns
    }
    return df.withColumn("_fit", fit).withColumns(scaled).drop("_fit")
