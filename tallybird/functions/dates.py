"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(col: Column) -> Column:
    return F.trunc(col, "MM")


def calendar(df: DataFrame, day: str, by: list[str] | None = None) -> DataFrame:
    """Every day from the first to the last one present, per group of ``by``."""
    span = df.groupBy(*(by or [])).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    span = span.where(F.col("_first").isNotNull())
    return span.select(*(by or []), F.explode(F.sequence("_first", "_last")).alias(day))
