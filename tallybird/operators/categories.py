"""Categorical columns with any number of levels as sparse rows: a level table instead of matrix columns.

The level table gives each level its place in the model matrix. It is numbered without ordering all levels
in one task, joined to the rows, and never passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybird.operators.churn_features import CATEGORICAL, NUMERIC
from tallybird.sources.workspace import working_folder

SALTS = 16
_PARTITION = 1 << 33  # where a row's partition begins in its running id


def category_table(
    features: DataFrame, columns: Sequence[str] = CATEGORICAL, first: int = len(NUMERIC)
) -> DataFrame:
    """(source, level, place): the matrix places of all levels but the least of each column, counted from
    ``first`` in the order of ``columns`` and then of levels. NULL is no level.

    Levels are dealt out in ranges; a row's number within its range and the sizes of the ranges before
    it, one row each, make its place. The numbered table is written once.
    """
    spark = features.sparkSession
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("source"), F.col(c).cast("string").alias("level"))
                      for k, c in enumerate(columns)])
    levels = features.select(F.inline(pairs)).where("level IS NOT NULL").distinct()
    least = levels.groupBy("k").agg(F.min("level").alias("level"))  # one row per column
    kept = levels.join(F.broadcast(least), ["k", "level"], "left_anti")
    folder = working_folder(spark, "levels")
    ordered = kept.repartitionByRange("k", "level").sortWithinPartitions("k", "level")
    ordered.withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    numbered = spark.read.parquet(folder).withColumn("range", F.floor(F.col("at") / _PARTITION))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = numbered.groupBy("range").agg(F.count("*").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.lit(first) + F.col("before") + F.col("at") % _PARTITION
    return numbered.join(ranges, "range").select("source", "level", place.cast("bigint").alias("place"))


def sparse_features(
    features: DataFrame,
    table: DataFrame,
    columns: Sequence[str] = CATEGORICAL,
    keep: Sequence[str] = ("customer_id", "churned"),
) -> DataFrame:
    """``keep``, the numeric columns, and ``places``: the sorted matrix places that hold a 1.

    With the level table of a trained model the rows are aligned to it: levels it does not know set
    nothing. A level that a third of all rows have is dealt to ``SALTS`` places of the join.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    out = features.select(*keep, *NUMERIC, *[c for c in columns if c not in keep])
    out = out.withColumn("_salt", F.pmod(F.xxhash64(*keep), F.lit(SALTS)))
    for k, c in enumerate(columns):
        own = table.where(F.col("source") == c).select(
            F.col("level").alias(c), F.col("place").alias(f"_place{k}"), salts.alias("_salt")
        )
        out = out.withColumn(c, F.col(c).cast("string")).join(own, [c, "_salt"], "left")
    places = F.array_sort(F.array_compact(F.array(*[F.col(f"_place{k}") for k in range(len(columns))])))
    return out.select(*keep, *NUMERIC, places.alias("places"))


def dense_view(sparse: DataFrame, table: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Chosen places as 0/1 columns: ``wanted`` names (source, level) per column. A level without a
    place gives a column of zeros."""
    pairs = [(F.col("source") == source) & (F.col("level") == level) for source, level in wanted.values()]
    places = table.agg(F.struct(*[F.max(F.when(p, F.col("place"))).alias(f"c{k}") for k, p in enumerate(pairs)]).alias("p"))
    held = sparse.withColumn("_p", places.scalar())
    flags = [
        F.coalesce(F.array_contains("places", F.col(f"_p.c{k}")), F.lit(False)).cast("int").alias(name)
        for k, name in enumerate(wanted)
    ]
    return held.select(*[c for c in sparse.columns if c != "places"], *flags)
