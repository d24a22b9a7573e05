"""Unusual days by z-score, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.stats import one_row
from tallybird.operators.daily import METRICS

# Limits of the z-score classes and their names.
HIGH_Z, MEDIUM_Z = 3, 2
HIGH, MEDIUM, NORMAL = "HIGH", "MEDIUM", "Normal"
Z_DIGITS = 6


def _moments(daily: DataFrame, metrics: Sequence[str]) -> Column:
    return one_row(
        daily,
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
    )


def severity(z: Column) -> Column:
    return (
        F.when(F.abs(z) > HIGH_Z, HIGH)
        .when(F.abs(z).between(MEDIUM_Z, HIGH_Z), MEDIUM)
        .otherwise(NORMAL)
    )


def zscore_anomalies(daily: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Add ``<metric>_zscore`` and ``<metric>_anomaly``. Scores are rounded to six digits before
    they are classed, so that a class does not hang on the order of a floating-point sum."""
    scores = {
        f"{m}_zscore": F.round(
            F.try_divide(F.col(m) - F.col(f"_fit.{m}_mean"), F.col(f"_fit.{m}_std")), Z_DIGITS
        )
        for m in metrics
    }
    classes = {f"{m}_anomaly": severity(F.col(f"{m}_zscore")) for m in metrics}
    columns = [c for m in metrics for c in (f"{m}_zscore", f"{m}_anomaly")]
    return (
        daily.withColumn("_fit", _moments(daily, metrics))
        .withColumns(scores)
        .withColumns(classes)
        .select(*daily.columns, *columns)
    )


def anomaly_alerts(anomalies: DataFrame, metric: str = "daily_revenue") -> DataFrame:
    """The days of class HIGH: metric, date, expected range (mean +- 2 deviations), value."""
    mean, std = F.col(f"_fit.{metric}_mean"), F.col(f"_fit.{metric}_std")
    return (
        anomalies.withColumn("_fit", _moments(anomalies, [metric]))
        .where(F.col(f"{metric}_anomaly") == HIGH)
        .select(
            F.initcap(F.replace(F.lit(metric), F.lit("_"), F.lit(" "))).alias("metric"),
            "order_date",
            (mean - 2 * std).alias("expected_low"),
            (mean + 2 * std).alias("expected_high"),
            F.col(metric).cast("double").alias("actual"),
            F.col(f"{metric}_anomaly").alias("severity"),
        )
        .orderBy("order_date")
    )


def known_anomaly_check(
    flagged: DataFrame, year: int, month: int, column: str, flags: Sequence[str]
) -> DataFrame:
    """Was any day of a month known to be unusual flagged? ``column`` holds the class."""
    in_month = (F.year("order_date") == year) & (F.month("order_date") == month)
    hit = F.bool_or(F.col(column).isin(list(flags)))
    return flagged.where(in_month).agg(F.coalesce(hit, F.lit(False)).alias("caught"))
