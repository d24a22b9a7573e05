"""Referential checks: the declared keys of the star schema as data-quality jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybird.schemas import FOREIGN_KEYS, PRIMARY_KEY


def valid_reviews(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Reviews whose order is known."""
    return reviews.join(orders.select("order_id"), "order_id", "left_semi").select(reviews.columns)


def orphan_reviews(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    return reviews.join(orders.select("order_id"), "order_id", "left_anti").select(reviews.columns)


def _orphans(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Rows per unknown key. The child is counted per key first, so a key that holds much of the
    table is one row by the time it meets the parent."""
    counted = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return counted.join(parent.select(column), column, "left_anti")


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (check_name, n_violations): null and repeated primary keys, orphan foreign keys."""
    parts = []
    for table, key in PRIMARY_KEY.items():
        counted = tables[table].groupBy(key).agg(F.count("*").alias("_n"))
        found = {
            "null": F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)),
            "duplicate": F.count(F.when(F.col(key).isNotNull() & (F.col("_n") > 1), 1)),
        }
        lines = [
            F.struct(
                F.lit(f"{table}.{key} {kind}").alias("check_name"),
                F.col(kind).alias("n_violations"),
            )
            for kind in found
        ]
        totals = counted.agg(*[value.alias(kind) for kind, value in found.items()])
        parts.append(totals.select(F.inline(F.array(*lines))))
    for child, column, parent in FOREIGN_KEYS:
        orphans = _orphans(tables[child], tables[parent], column)
        parts.append(
            orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_violations")).select(
                F.lit(f"{child}.{column} orphan").alias("check_name"), "n_violations"
            )
        )
    return reduce(DataFrame.unionByName, parts)
