"""Raw table readers and structural validation."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybird.schemas import PRIMARY_KEY, RAW

CSV_OPTIONS = {
    "header": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "quote": '"',
    "escape": '"',
    "multiLine": True,  # a quoted text may hold line breaks; a folder's files are still read in parallel
    "enforceSchema": False,  # a part whose header differs is an error, not a silent swap of columns
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def typed_value(name: str, dtype: T.DataType) -> Column:
    """The declared type of a text, NULL if it is none. Whole numbers may be written with a
    fraction of zero (``34.0``), as tools write integer columns that have gaps."""
    value = F.trim(F.col(f"`{name}`"))
    if isinstance(dtype, T.StringType):
        return F.col(f"`{name}`")
    if isinstance(dtype, _WHOLE):
        number = value.try_cast("double")
        whole = F.when(number == F.floor(number), value.try_cast("decimal(38,6)").try_cast(dtype))
        return F.coalesce(value.try_cast(dtype), whole)
    return value.try_cast(dtype)


def bad_value(name: str, dtype: T.DataType) -> Column:
    """A text that is there but is no value of the declared type."""
    return (F.trim(F.col(f"`{name}`")) != "") & typed_value(name, dtype).isNull()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV with every column as text."""
    reader = spark.read.options(**CSV_OPTIONS)
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"raw file not found: {path}") from error
        raise


def with_types(texts: DataFrame, schema: T.StructType) -> DataFrame:
    known = {field.name: field.dataType for field in schema}
    return texts.select([typed_value(c, known.get(c, T.StringType())).alias(c) for c in texts.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read headered CSV by column *name*: columns may come in any order, extras are kept as text,
    missing ones stay missing (for validation to report). Types are declared, never inferred; a
    value that is not of its type is NULL here and counted by ``validation_report``."""
    return with_types(read_text(spark, path), schema)


def read_raw_text(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A raw table as it was delivered, for validation."""
    return read_text(spark, f"{folder}/{table}.csv")


def read_raw(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return read_csv(spark, f"{folder}/{table}.csv", RAW[table])


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Scan a database table; pass ``partitionColumn`` and bounds to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [name for name in RAW[table].names if name not in df.columns]


def validation_report(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per table: size, missing columns, values that are not of their declared type (in
    columns read as text), NULL keys, and verdict (ok / empty / missing columns / bad values)."""
    rows = []
    for table, df in frames.items():
        missing = missing_columns(df, table)
        texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
        checks = [
            F.count_if(bad_value(f.name, f.dataType))
            for f in RAW[table]
            if f.name in texts and not isinstance(f.dataType, T.StringType)
        ]
        key = PRIMARY_KEY[table]
        no_key = F.lit(0)
        if key in df.columns:
            value = typed_value(key, RAW[table][key].dataType) if key in texts else F.col(key)
            no_key = F.count_if(value.isNull())
        rows.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.coalesce(sum(checks, F.lit(0)), F.lit(0)).cast("long").alias("n_bad_values"),
                F.coalesce(no_key, F.lit(0)).cast("long").alias("n_null_keys"),
            ).select(
                F.lit(table).alias("table_name"),
                "n_rows",
                F.lit(len(df.columns)).cast("long").alias("n_cols"),
                F.lit(", ".join(missing)).alias("missing_columns"),
                "n_bad_values",
                "n_null_keys",
                F.when(F.lit(bool(missing)), "missing columns")
                .when(F.col("n_rows") == 0, "empty")
                .when(F.col("n_bad_values") + F.col("n_null_keys") > 0, "bad values")
                .otherwise("ok")
                .alias("status"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def require_valid(df: DataFrame, table: str) -> DataFrame:
    """Strict mode: pass the frame through or raise."""
    missing = missing_columns(df, table)
    if missing:
        raise ValueError(f"{table} lacks expected columns: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError(f"{table} has no rows")
    report = validation_report({table: df}).first()
    if report["status"] != "ok":
        raise ValueError(
            f"{table} has {report['n_bad_values']} values of a wrong type and {report['n_null_keys']} rows without key"
        )
    return df


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every raw table of a landing folder, validated as delivered, then typed."""
    return {
        table: with_types(require_valid(read_raw_text(spark, folder, table), table), RAW[table])
        for table in RAW
    }
