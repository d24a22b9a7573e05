"""Exact money arithmetic on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybird.schemas import MONEY


def as_money(col: Column) -> Column:
    return F.round(col.cast("decimal(24,8)"), 2).cast(MONEY)


def mean_money(col: Column, digits: int) -> Column:
    """Mean of a decimal column, rounded half up; sum and count stay exact until the division."""
    return F.round(F.sum(col) / F.nullif(F.count(col), F.lit(0)), digits)


def exact_mean(col: Column) -> Column:
    """Mean of a decimal or integer column as a double, independent of row order."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))
