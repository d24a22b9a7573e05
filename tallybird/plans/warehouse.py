"""Staged tables: raw -> clean -> star schema, written once per application and input state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.operators import rfm, sentiment
from tallybird.operators.cleaning import clean_all
from tallybird.operators.quality import orphan_reviews, valid_reviews
from tallybird.schemas import LOAD_ORDER, STAR, star_name
from tallybird.sources.retail_views import COPY, numbered_orders, raw_tables, reviews_of
from tallybird.sources.sinks import append_if_empty, conform, export_csv, replace_table
from tallybird.sources.workspace import is_complete, staging_path


def staged_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The raw tables, each derived and written once: cleaning, checks and loads read them often.
    Orders keep the number of the copy in their files; reviews are derived from the orders written."""
    target = f"{staging_path(spark, folder)}/raw"
    derived = raw_tables(spark, folder)
    orders = numbered_orders(spark, folder)
    written = spark.read.schema(orders.schema).parquet
    sources = {
        **{name: lambda df=df: df for name, df in derived.items()},
        "orders": lambda: orders,
        "reviews": lambda: reviews_of(written(f"{target}/orders").where(F.col(COPY) == 1)),
    }
    for name, source in sources.items():
        if not is_complete(spark, f"{target}/{name}"):
            source().write.mode("overwrite").parquet(f"{target}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{target}/{name}") for name, df in derived.items()}


def star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR[name]).parquet(f"{folder}/{name}")


def load_star_schema(spark: SparkSession, clean: dict[str, DataFrame], target: str) -> DataFrame:
    """Load the five clean tables in dependency order, each only if its target is empty; reviews
    of unknown orders are left out. Returns one row per table as found after the load."""
    report = []
    for position, table in enumerate(LOAD_ORDER, start=1):
        name = star_name(table)
        df = conform(clean[table], STAR[name])
        skipped = F.lit(0).cast("bigint")
        if table == "reviews":
            orders = star_table(spark, target, "orders")
            skipped = orphan_reviews(df, orders).agg(F.count("*")).scalar()
            df = valid_reviews(df, orders)
        append_if_empty(spark, df, f"{target}/{name}")
        loaded = star_table(spark, target, name).agg(F.count("*").alias("n_rows"))
        report.append(
            loaded.select(
                F.lit(position).cast("bigint").alias("load_order"),
                F.lit(name).alias("table_name"),
                "n_rows",
                skipped.alias("n_skipped"),
            )
        )
    result = report[0]
    for line in report[1:]:
        result = result.unionByName(line)
    return result


def star_schema(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The loaded star schema for an input folder; the first call in an application builds it."""
    target = f"{staging_path(spark, folder)}/star"
    if not all(is_complete(spark, f"{target}/{name}") for name in STAR):
        load_star_schema(spark, clean_all(staged_raw(spark, folder)), target)
    return {name: star_table(spark, target, name) for name in STAR}


def staged(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A derived table that several jobs read, written by the first of them."""
    path = f"{staging_path(spark, folder)}/derived/{name}"
    if not is_complete(spark, path):
        return replace_table(build(), path)
    return spark.read.parquet(path)


def rfm_base(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring reads recency, frequency and value several times over; the orders only once."""
    return staged(
        spark, folder, "rfm_base", lambda: rfm.rfm_base(star_schema(spark, folder)["orders"])
    )


def customer_rfm(spark: SparkSession, folder: str) -> DataFrame:
    return staged(
        spark,
        folder,
        "customer_rfm",
        lambda: rfm.rfm_segments(rfm.rfm_scores(rfm_base(spark, folder))),
    )


def review_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return staged(
        spark,
        folder,
        "review_sentiment",
        lambda: sentiment.review_sentiment(star_schema(spark, folder)["reviews"]),
    )


def landing_zone(spark: SparkSession, folder: str) -> str:
    """The raw tables as headered CSV files, as an upstream system would deliver them."""
    target = f"{staging_path(spark, folder)}/landing"
    for name, df in staged_raw(spark, folder).items():
        if not is_complete(spark, f"{target}/{name}.csv"):
            export_csv(df, f"{target}/{name}.csv")
    return target


def faulty_orders(spark: SparkSession, folder: str) -> str:
    """The raw orders as CSV files in which records are spoilt by rules over their key: no key at each
    17th, a quantity that is no number at each 11th, a field too many at each 13th. Whole lines are written."""
    target = f"{staging_path(spark, folder)}/faulty/orders.csv"
    if not is_complete(spark, target):
        orders = staged_raw(spark, folder)["orders"]
        spoilt = lambda n, good, bad: F.when(F.col("order_id") % n == 0, bad).otherwise(good)
        texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in orders.columns}
        texts["order_id"] = spoilt(17, texts["order_id"], F.lit(""))
        texts["quantity"] = spoilt(11, texts["quantity"], F.lit("many"))
        line = F.concat(F.concat_ws(",", *texts.values()), spoilt(13, F.lit(""), F.lit(",more")))
        header = F.lit(",".join(orders.columns))
        # each file begins with the header: the first record of a partition brings it along
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        lines = orders.select(F.when(first, F.concat(header, F.lit("\n"), line)).otherwise(line).alias("value"))
        lines.write.mode("overwrite").text(target)
    return target
