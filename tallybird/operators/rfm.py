"""Recency, frequency and monetary value per customer, quintile scores and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybird.functions.money import exact_mean
from tallybird.functions.stats import (
    exact_quantiles,
    running_total,
    small_domain_quantiles,
)
from tallybird.operators.business import delivered

QUINTILE_EDGES = [0.2, 0.4, 0.6, 0.8]


def rfm_base(orders: DataFrame) -> DataFrame:
    """One row per customer with a Delivered order; recency counts back from the day after the
    last Delivered order."""
    rows = delivered(orders).where(F.col("customer_id").isNotNull())
    last_day = delivered(orders).agg(F.max("order_date")).scalar()
    return (
        rows.groupBy("customer_id")
        .agg(
            F.max("order_date").alias("_last"),
            F.count("order_id").alias("frequency"),
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("monetary"),
        )
        .select(
            "customer_id",
            (F.datediff(last_day, F.col("_last")) + 1).alias("recency_days"),
            "frequency",
            "monetary",
        )
    )


def _quintile(value: Column, edges: Column) -> Column:
    """1 + number of edges below the value: bins closed on the right."""
    above = [F.when(value.cast("double") > F.element_at(edges, k), 1).otherwise(0)
             for k in range(1, 5)]
    return F.lit(1) + above[0] + above[1] + above[2] + above[3]


def _frequency_cuts(rfm: DataFrame) -> DataFrame:
    """The four customers after which the next quintile starts, in order of (frequency, id).

    Position i of n (from 0) exceeds cut k if 5 i > k (n - 1), so the cut is at position
    k (n - 1) div 5. Frequencies are counted first: their distinct values are few (a thousand
    different ones already need half a million orders). Only customers whose frequency is hit by
    a cut are then put in order of id, in ranges, so that a frequency shared by very many
    customers is not one task.
    """
    counts = rfm.groupBy("frequency").agg(F.count(F.lit(1)).alias("_n"))
    upwards = Window.orderBy("frequency").rowsBetween(Window.unboundedPreceding, 0)
    levels = counts.select(
        "frequency",
        (F.sum("_n").over(upwards) - F.col("_n")).alias("_below"),
        F.sum("_n").over(upwards).alias("_upto"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    cut = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")
    wanted = (
        levels.select("frequency", "_below", "_upto", "_all", cut)
        .withColumn("_position", F.expr("k * (_all - 1) div 5"))
        .where((F.col("_position") >= F.col("_below")) & (F.col("_position") < F.col("_upto")))
        .select("k", "frequency", (F.col("_position") - F.col("_below") + 1).alias("_rank"))
    )
    tied = rfm.select("frequency", "customer_id", F.lit(1).alias("_one")).join(
        F.broadcast(wanted.select("frequency").distinct()), "frequency", "left_semi"
    )
    ranked = running_total(tied, "customer_id", "_one", by=["frequency"])
    return ranked.join(
        F.broadcast(wanted.withColumnRenamed("_rank", "_upto")), ["frequency", "_upto"]
    ).select("k", "frequency", "customer_id")


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Add r_score, f_score, m_score (1-5, 5 best) and their digits as rfm_score."""
    recency = small_domain_quantiles(rfm, "recency_days", QUINTILE_EDGES).scalar()
    monetary = exact_quantiles(rfm, "monetary", QUINTILE_EDGES).scalar()
    cuts = _frequency_cuts(rfm).agg(
        F.array_sort(F.collect_list(F.struct("frequency", "customer_id")))  # four rows
    ).scalar()
    own = F.struct("frequency", "customer_id")
    beyond = [
        F.when(own > F.element_at("_cuts", k), 1).otherwise(0) for k in range(1, 5)
    ]
    return (
        rfm.withColumn("_r", recency)
        .withColumn("_m", monetary)
        .withColumn("_cuts", cuts)
        .withColumn("r_score", F.lit(6) - _quintile(F.col("recency_days"), F.col("_r")))
        .withColumn("f_score", F.lit(1) + beyond[0] + beyond[1] + beyond[2] + beyond[3])
        .withColumn("m_score", _quintile(F.col("monetary"), F.col("_m")))
        .withColumn("rfm_score", F.concat("r_score", "f_score", "m_score"))
        .drop("_r", "_m", "_cuts")
    )


def segment_of(r: Column, f: Column) -> Column:
    """Segment names and the score limits that lead to them, first match wins."""
    return (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when((r >= 3) & (f >= 4), "Loyal Customers")
        .when((r >= 4) & f.between(2, 3), "Potential Loyalists")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("Needs Attention")
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.withColumn("segment", segment_of(F.col("r_score"), F.col("f_score")))


def customer_rfm(orders: DataFrame) -> DataFrame:
    return rfm_segments(rfm_scores(rfm_base(orders)))


def segment_counts(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("num_customers"))
        .orderBy(F.desc("num_customers"), "segment")
    )


def segment_avg_value(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy("segment")
        .agg(exact_mean(F.col("monetary")).alias("avg_monetary"))
        .orderBy(F.desc("avg_monetary"), "segment")
    )
