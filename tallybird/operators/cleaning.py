"""Cleaning jobs, one per raw table. The order of steps is part of each job's meaning:
duplicates go before text is normalised, medians are taken of what is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.money import as_money
from tallybird.functions.stats import median
from tallybird.functions.text import strip_whitespace, title_case

# Replacements for missing text.
UNKNOWN_GENDER = "Unknown"
NO_TEXT = "No review text provided"


def _tidy(name: str) -> Column:
    return title_case(strip_whitespace(F.col(name)))


def _filled(df: DataFrame, name: str, small_domain: bool, approx: bool) -> Column:
    """The column as a double, gaps filled with its median."""
    middle = median(df, name, small_domain=small_domain, approx=approx)
    return F.coalesce(F.col(name).cast("double"), middle)


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(18,6)")


def clean_customers(raw: DataFrame, approx: bool = False) -> DataFrame:
    rows = raw.dropDuplicates()
    signup = F.to_date("signup_date")
    latest = rows.agg(F.max(signup)).scalar()
    return rows.select(
        "customer_id",
        "customer_name",
        _filled(rows, "age", small_domain=True, approx=approx).alias("age"),
        F.coalesce("gender", F.lit(UNKNOWN_GENDER)).alias("gender"),
        _tidy("city").alias("city"),
        signup.alias("signup_date"),
        "customer_segment",
        F.datediff(latest, signup).alias("tenure_days"),
    )


def _possible_inventory(rows: DataFrame) -> DataFrame:
    return rows.withColumn("inventory", F.when(F.col("inventory") >= 0, F.col("inventory")))


def clean_products(raw: DataFrame, approx: bool = False) -> DataFrame:
    rows = _possible_inventory(raw.dropDuplicates())
    price, margin = _exact("selling_price"), _exact("selling_price") - _exact("cost")
    share = F.try_divide(margin, F.nullif(price, F.lit(0)))
    return rows.select(
        "product_id",
        "category",
        "brand",
        "cost",
        "selling_price",
        _filled(rows, "inventory", small_domain=False, approx=approx).cast("int")
        .alias("inventory"),
        as_money(margin).alias("profit_margin"),
        F.round(share, 3).cast("decimal(12,3)").alias("margin_pct"),
    )


def _possible_orders(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("quantity") > 0) & (F.col("price") > 0))


def clean_orders(raw: DataFrame, approx: bool = False) -> DataFrame:
    rows = _possible_orders(raw.dropDuplicates())
    kept_share = F.lit(1) - F.col("discount").cast("decimal(7,6)")
    revenue = F.col("price").cast("decimal(16,4)") * F.col("quantity") * kept_share
    return rows.select(
        "order_id",
        "customer_id",
        "product_id",
        F.to_date("order_date").alias("order_date"),
        "quantity",
        "price",
        "discount",
        _tidy("payment_method").alias("payment_method"),
        _filled(rows, "delivery_time", small_domain=True, approx=approx).alias("delivery_time"),
        "status",
        as_money(revenue).alias("revenue"),
    )


def clean_reviews(raw: DataFrame) -> DataFrame:
    return raw.dropDuplicates().select(
        "review_id",
        "customer_id",
        "order_id",
        "rating",
        F.coalesce("review_text", F.lit(NO_TEXT)).alias("review_text"),
        F.to_date("review_date").alias("review_date"),
    )


def clean_marketing(raw: DataFrame, approx: bool = False) -> DataFrame:
    rows = raw.dropDuplicates()
    return rows.withColumn("spend", _filled(rows, "spend", small_domain=False, approx=approx))


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "customers": clean_customers(raw["customers"]),
        "products": clean_products(raw["products"]),
        "orders": clean_orders(raw["orders"]),
        "reviews": clean_reviews(raw["reviews"]),
        "marketing": clean_marketing(raw["marketing"]),
    }


def _nulls(name: str) -> Column:
    return F.count(F.when(F.col(name).isNull(), 1))


def _counted(raw: DataFrame) -> DataFrame:
    """The different rows of a table and how often each occurs, in ``_copies``."""
    return raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies"))


def _lines(table: str, rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows (table, check, value) from one aggregate of the counted rows."""
    measured = [value.alias(name) for name, value in checks.items()]
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum("_copies").alias("_all"), *measured)
    values = {"duplicates_removed": F.coalesce("_all", F.lit(0)) - F.col("_n")}
    values |= {name: F.col(name) for name in checks}
    values.setdefault("rows_saved", F.col("_n"))
    entries = [
        F.struct(F.lit(name).alias("check_name"), value.cast("double").alias("value"))
        for name, value in values.items()
    ]
    return stats.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


def _middle(table: str, column: str, df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(table).alias("table_name"),
        F.lit(f"median_{column}").alias("check_name"),
        median(df, column).alias("value"),
    )


def cleaning_report(raw: dict[str, DataFrame]) -> DataFrame:
    """What each cleaning step removed or filled, as rows of (table, check, value).

    Each table is grouped once by all its columns; duplicates, fills, removals and the medians of small
    domains come out of one aggregate of the groups. The other medians range over the same groups."""
    rows = {name: _counted(df) for name, df in raw.items()}
    rows["products"] = _possible_inventory(rows["products"])
    possible = F.coalesce((F.col("quantity") > 0) & (F.col("price") > 0), F.lit(False))
    no_time = F.col("delivery_time").isNull()
    checks = {
        "customers": {
            "age_filled": _nulls("age"),
            "gender_filled": _nulls("gender"),
            "median_age": F.percentile("age", 0.5),
        },
        "products": {"inventory_filled": _nulls("inventory")},
        "orders": {
            "impossible_removed": F.count(F.when(~possible, 1)),
            "delivery_time_filled": F.count(F.when(possible & no_time, 1)),
            "rows_saved": F.count(F.when(possible, 1)),
            "median_delivery_time": F.percentile(F.when(possible, F.col("delivery_time")), 0.5),
        },
        "reviews": {"review_text_filled": _nulls("review_text")},
        "marketing": {"spend_filled": _nulls("spend")},
    }
    parts = [_lines(name, rows[name], found) for name, found in checks.items()]
    parts += [_middle("products", "inventory", rows["products"]), _middle("marketing", "spend", rows["marketing"])]
    return reduce(DataFrame.unionByName, parts)
