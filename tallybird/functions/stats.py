"""Exact order statistics and guarded moments that do not gather a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128


def one_row(df: DataFrame, *aggs: Column) -> Column:
    """Whole-table aggregates as a struct-valued scalar subquery.

    The subquery runs once, its single row is shipped as a constant, nothing is collected.
    """
    return df.agg(F.struct(*aggs).alias("_stats")).scalar()


def spread(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``_bucket``: ranges of ``value`` that hold about equally many rows, in value order.

    The ``buckets - 1`` split points come from a mergeable quantile sketch, so they may be a
    little uneven, but any split points give a correct order. ``buckets`` is a power of two; the
    bucket is found by bisection.
    """
    wanted = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    splits = df.select(F.col(value).cast("double").alias("v")).selectExpr(
        f"percentile_approx(v, array({wanted}), {8 * buckets}) AS splits"
    ).scalar()
    steps = [2**level for level in reversed(range(buckets.bit_length() - 1))]
    key = F.col(value).cast("double")
    bisect = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: at + F.when(key > F.element_at("_splits", at + step), step).otherwise(0),
    )
    # never NULL, and said so: a join on a column that may be NULL would filter by it first, below the
    # shuffle that made ``df``, where every row and not every value would look for its bucket
    return df.withColumn("_splits", splits).withColumn("_bucket", F.coalesce(bisect, F.lit(0))).drop("_splits")


def running_total(
    df: DataFrame,
    value: str,
    weight: str,
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``_upto`` (sum of ``weight`` up to and including the row, in order of ``value``,
    within ``by``) and ``_total`` (sum within ``by``).

    ``value`` must be unique within ``by`` (aggregate first), ``by`` must not be NULL. A plain
    ordered window would sort a whole group in one task; here only one range of it, and the ranges
    are chained by their totals, which are at most ``buckets`` rows per group.
    """
    by = list(by)
    placed = spread(df, value, buckets)
    in_order = Window.partitionBy(*by).orderBy("_bucket")
    totals = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum(weight).alias("_w"))
        .select(
            *by,
            "_bucket",
            F.coalesce(
                F.sum("_w").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
            F.sum("_w").over(Window.partitionBy(*by)).alias("_total"),
        )
    )
    within = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("_within", F.sum(weight).over(within))
        .join(totals, [*by, "_bucket"])
        .withColumn("_upto", F.col("_before") + F.col("_within"))
        .drop("_bucket", "_before", "_within")
    )


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, _n). NULL counts 0 instead of being filtered out: a filter would move below the
    shuffle that made ``df``, which could then not be shared with the rest of the query."""
    return df.groupBy(value).agg(F.count(value).alias("_n"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row with ``q``: exact, linearly interpolated quantiles for any number of values.

    ``percentile`` keeps every distinct value in one task's memory; this keeps it to a range.
    Use ``small_domain_quantiles`` where the number of distinct values is known to be small.
    """
    ranked = running_total(value_counts(df, value), value, "_n")
    parts = []
    for p in probs:
        at = F.lit(float(p)) * (F.col("_total") - 1).cast("double")
        low = F.floor(at)
        x_low = F.min(F.when(F.col("_upto") > low, F.col(value))).cast("double")
        x_high = F.coalesce(
            F.min(F.when(F.col("_upto") > low + 1, F.col(value))).cast("double"), x_low
        )
        share = F.max(at - low)
        parts.append(x_low + (x_high - x_low) * share)
    return ranked.agg(F.array(*parts).alias("q"))


def small_domain_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Same result for columns with few distinct values (days, ages, counts): one map-side
    combined aggregate whose state is one counter per distinct value."""
    return df.agg(F.percentile(F.col(value), [float(p) for p in probs]).alias("q"))


def median(df: DataFrame, value: str, small_domain: bool = False, approx: bool = False) -> Column:
    """Whole-table median as a scalar subquery. ``approx`` trades exactness for one sketch pass."""
    if approx:
        return df.agg(F.percentile_approx(value, 0.5, 10000).cast("double").alias("m")).scalar()
    quantiles = small_domain_quantiles if small_domain else exact_quantiles
    return quantiles(df, value, [0.5]).select(F.element_at("q", 1).alias("m")).scalar()


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side or fewer than two pairs."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
