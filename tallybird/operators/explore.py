"""Exploratory aggregates: the numbers behind distribution charts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.dates import month_of
from tallybird.functions.stats import (
    exact_quantiles,
    one_row,
    safe_corr,
    small_domain_quantiles,
    value_counts,
)
from tallybird.operators.business import delivered


def _long(totals: DataFrame, entries: list[Column]) -> DataFrame:
    return totals.select(F.inline(F.array(*entries)))


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, n_nulls) from one aggregate over all columns."""
    totals = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return _long(
        totals,
        [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.col(c).alias("n_nulls"),
            )
            for c in df.columns
        ],
    )


def numeric_histogram(
    df: DataFrame, value: str, bins: int, metric: str | None = None, digits: int = 2
) -> DataFrame:
    """(metric, bin, low, high, n): equal-width bins over min..max, the last one closed, empty
    bins kept. Bins are found in whole units of 10^-digits, free of rounding at the edges."""
    unit = 10**digits
    units = df.select(F.round(F.col(value) * unit).cast("bigint").alias("u")).where(
        F.col("u").isNotNull()
    )
    ends = one_row(units, F.min("u").alias("low"), F.max("u").alias("high"))
    # a single value gets a range of one around it, like any histogram of a constant
    padded = F.when(F.col("_e.low") == F.col("_e.high"), F.lit(unit)).otherwise(F.lit(0))
    low, high = F.col("_e.low") * 2 - padded, F.col("_e.high") * 2 + padded  # in half units

    def bounded(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_e", ends).select("*", low.alias("_low"), high.alias("_high"))

    place = F.expr(f"(u * 2 - _low) * {bins} div (_high - _low)")
    counted = (
        bounded(units)
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_high") - F.col("_low")) / F.lit(2.0 * unit * bins)
    start = F.col("_low") / F.lit(2.0 * unit)
    spine = bounded(
        df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    ).where(F.col("_low").isNotNull())
    return spine.join(counted, "bin", "left").select(
        F.lit(metric or value).alias("metric"),
        "bin",
        (start + width * F.col("bin")).alias("low"),
        (start + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _kernel_sums(points: int):
    """Each task adds the kernels of its values on the grid: ``points`` numbers, whatever it reads."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, total = None, np.zeros(points)
        for batch in batches:
            x, n, low, step, width = (np.asarray(c, dtype=float) for c in batch.columns)
            if len(x) == 0 or not width[0] > 0:
                continue
            grid = low[0] + np.arange(points) * step[0]
            for at in range(0, len(x), 4096):
                off = (grid - x[at : at + 4096, None]) / width[0]
                total += n[at : at + 4096] @ np.exp(-0.5 * off * off)
        if grid is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(points, dtype=np.int32)), pa.array(grid), pa.array(total)],
                names=["point", "x", "weight"],
            )

    return add_up


def density_curve(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """(point, x, density): Gaussian kernel density with Scott's bandwidth on an even grid.

    Equal values are counted first; a task sums the kernels of its values as arrays, so ``points``
    rows per task are shuffled and no row is formed per value and point.
    """
    counts = value_counts(df, value).withColumn("_x", F.col(value).cast("double"))
    shape = one_row(
        df,
        F.count(value).alias("n"),
        F.stddev_samp(F.col(value).cast("double")).alias("std"),
        F.min(F.col(value).cast("double")).alias("low"),
        F.max(F.col(value).cast("double")).alias("high"),
    )
    bandwidth = F.col("_s.std") * F.pow(F.col("_s.n").cast("double"), F.lit(-0.2))
    placed = counts.where("_x IS NOT NULL").select(
        "_x",
        F.col("_n").cast("double").alias("_n"),
        shape.alias("_s"),
    ).select(
        "_x",
        "_n",
        F.col("_s.low").alias("low"),
        ((F.col("_s.high") - F.col("_s.low")) / (points - 1)).alias("step"),
        F.coalesce(bandwidth, F.lit(0.0)).alias("width"),
    )
    sums = placed.mapInArrow(_kernel_sums(points), "point int, x double, weight double")
    scale = F.sqrt(F.lit(2.0) * F.pi()) * bandwidth * F.col("_s.n")
    return (
        sums.groupBy("point")
        .agg(F.first("x").alias("x"), F.sum("weight").alias("weight"))
        .withColumn("_s", shape)
        .select("point", "x", (F.col("weight") / scale).alias("density"))
    )


def tukey_outliers(df: DataFrame, small_domain: dict[str, bool]) -> DataFrame:
    """Box-plot numbers per column of ``small_domain`` (column -> few distinct values?): quartiles,
    whiskers (furthest value within 1.5 interquartile ranges) and the count beyond them."""
    parts = []
    for column, few in small_domain.items():
        quantiles = small_domain_quantiles if few else exact_quantiles
        quartiles = quantiles(df, column, [0.25, 0.5, 0.75]).scalar()
        x = F.col("x")
        reach = (F.col("_q")[2] - F.col("_q")[0]) * 1.5
        inside = (x >= F.col("_q")[0] - reach) & (x <= F.col("_q")[2] + reach)
        parts.append(
            df.select(F.col(column).cast("double").alias("x"))
            .where(x.isNotNull())
            .withColumn("_q", quartiles)
            .agg(
                F.first("_q").alias("_q"),
                F.min(F.when(inside, x)).alias("low_whisker"),
                F.max(F.when(inside, x)).alias("high_whisker"),
                F.count(F.when(~inside, 1)).alias("n_outliers"),
            )
            .select(
                F.lit(column).alias("metric"),
                F.col("_q")[0].alias("q1"),
                F.col("_q")[1].alias("median"),
                F.col("_q")[2].alias("q3"),
                "low_whisker",
                "high_whisker",
                "n_outliers",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, r) for every ordered pair of columns, over the rows where both are known.

    Every pair (upper half) is a few sums of one aggregate; pairs go five to an aggregate, so that
    none becomes too large a piece of generated code.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    parts = []
    for at in range(0, len(pairs), 5):
        sums = {k: safe_corr(F.col(a), F.col(b)) for k, (a, b) in enumerate(pairs[at : at + 5], start=at)}
        lines = [F.struct(F.lit(k).alias("pair"), F.col(f"r{k}").alias("r")) for k in sums]
        parts.append(df.agg(*[r.alias(f"r{k}") for k, r in sums.items()]).select(F.inline(F.array(*lines))))
    found = reduce(DataFrame.unionByName, parts)
    named = F.element_at(
        F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs]),
        F.col("pair") + 1,
    )
    upper = found.select(named.alias("n"), "r").select("n.x", "n.y", "r")
    same = F.col("x") == F.col("y")
    turned = F.explode(F.when(same, F.lit([False])).otherwise(F.lit([False, True])))
    return upper.withColumn("turned", turned).select(
        F.when(F.col("turned"), F.col("y")).otherwise(F.col("x")).alias("x"),
        F.when(F.col("turned"), F.col("x")).otherwise(F.col("y")).alias("y"),
        "r",
    )


def monthly_revenue(orders: DataFrame) -> DataFrame:
    return (
        delivered(orders)
        .groupBy(month_of(F.col("order_date")).alias("month"))
        .agg(F.sum("revenue").alias("monthly_revenue"))
        .orderBy("month")
    )


def orders_per_customer(orders: DataFrame) -> DataFrame:
    known = delivered(orders).where(F.col("customer_id").isNotNull())
    return known.groupBy("customer_id").agg(F.count(F.lit(1)).alias("num_orders"))


def orders_per_customer_stats(orders: DataFrame) -> DataFrame:
    """describe() of the number of orders per customer. Order counts repeat a lot: a thousand
    different ones already take half a million orders."""
    return orders_per_customer(orders).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("num_orders").alias("mean"),
        F.stddev_samp("num_orders").alias("std"),
        F.min("num_orders").alias("min"),
        *[F.percentile("num_orders", p).alias(n)
          for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))],
        F.max("num_orders").alias("max"),
    )


def revenue_by_dimension(
    orders: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    """(dimension, value, total_revenue) by product category and by customer city. Orders are
    summed per key before each join."""

    def by(key: str, table: DataFrame, column: str) -> DataFrame:
        per_key = delivered(orders).groupBy(key).agg(F.sum("revenue").alias("_revenue"))
        return (
            per_key.join(table.select(key, column), key)
            .groupBy(F.lit(column).alias("dimension"), F.col(column).alias("value"))
            .agg(F.sum("_revenue").alias("total_revenue"))
        )

    both = by("product_id", products, "category").unionByName(by("customer_id", customers, "city"))
    return both.orderBy("dimension", F.desc_nulls_first("total_revenue"), "value")
