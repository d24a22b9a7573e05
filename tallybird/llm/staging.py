"""Tables that several jobs of one operator read, written where all executors can reach them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallybird.sources.workspace import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder nobody has used, below the one that ``spark.checkpoint.dir`` names."""
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its work is done once, and a lost executor
    loses none of it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
