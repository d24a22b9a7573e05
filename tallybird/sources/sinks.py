"""Table writers: replace, append once, export."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybird.sources.landing import CSV_OPTIONS
from tallybird.sources.workspace import is_complete, move_into_place


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write a derived table in full and return it as read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Headered CSV, one file per partition so that the export stays parallel."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def _typed(name: str, source: T.DataType, target: T.DataType) -> Column:
    """Numbers are rounded, not cut, on their way into a narrower column."""
    col = F.col(name)
    if isinstance(target, T.DecimalType) and isinstance(source, T.FractionalType):
        return F.round(col.cast("decimal(28,8)"), target.scale).cast(target).alias(name)
    if isinstance(target, T.IntegerType) and isinstance(source, T.FractionalType):
        return F.bround(col, 0).cast(target).alias(name)
    return col.cast(target).alias(name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a declared schema: its columns, order and types."""
    return df.select([_typed(f.name, df.schema[f.name].dataType, f.dataType) for f in schema])


@dataclass(frozen=True)
class Load:
    path: str
    appended: bool
    rows_before: int


def append_if_empty(spark: SparkSession, df: DataFrame, path: str) -> Load:
    """Load ``df`` unless the target already holds a complete load with rows, so that a load can be
    run again. What a load that did not end has left (no ``_SUCCESS``) is not taken for one: the
    load is written beside it and put in its place when complete."""
    if is_complete(spark, path):
        rows_before = spark.read.schema(df.schema).parquet(path).count()
        if rows_before:
            return Load(path, False, rows_before)
    draft = f"{path}.loading-{uuid.uuid4().hex[:12]}"
    df.write.parquet(draft)
    move_into_place(spark, draft, path)
    return Load(path, True, 0)
