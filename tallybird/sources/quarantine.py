"""Bad records of a raw table kept apart, with their file, the reasons and the text as delivered.

``split_raw`` reads and judges a table once and writes both parts in the same job, as one table with a
partition per verdict. ``accepted`` and ``rejected`` read them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybird.schemas import PRIMARY_KEY, RAW
from tallybird.sources.landing import CSV_OPTIONS, bad_value, missing_columns, read_text, typed_value
from tallybird.sources.workspace import move_into_place

ACCEPTED, REJECTED = "accepted", "rejected"
_LINE = "_line"  # the text of a record whose number of fields is wrong
_OWN = ["_verdict", "_file", "_reasons", "_record"]


def _reasons(table: str, columns: list[str]) -> Column:
    key = PRIMARY_KEY[table]
    found = [F.when(F.col(_LINE).isNotNull(), "wrong number of fields")]
    found += [
        F.when(bad_value(f.name, f.dataType), f"bad value: {f.name}")
        for f in RAW[table]
        if f.name in columns and not isinstance(f.dataType, T.StringType)
    ]
    found.append(F.when(F.trim(F.coalesce(F.col(f"`{key}`"), F.lit(""))) == "", f"no key: {key}"))
    return F.array_compact(F.array(*found))


def judged_raw(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Every record of a headered CSV file or folder: the typed columns, verdict, file, reasons, and for
    rejected records the text: the line where the number of fields is wrong, else the fields as JSON.

    A value that is not of its type, a missing key and a wrong number of fields reject a record, each is
    listed. Absent values are no fault. Columns beyond the declared ones are kept as text; names that
    begin with the ones added here are refused, as is a file that lacks declared columns. A folder without
    records gives an empty table; repeated records are judged alike.
    """
    delivered = read_text(spark, path)
    missing = missing_columns(delivered, table)
    if missing:
        raise ValueError(f"{table} lacks expected columns: {', '.join(missing)}")
    columns = delivered.columns
    clash = sorted({*_OWN, _LINE} & set(columns))
    if clash:
        raise ValueError(f"{table} has columns of reserved names: {', '.join(clash)}")
    known = {f.name: f.dataType for f in RAW[table]}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _LINE]])
    texts = spark.read.schema(schema).options(**CSV_OPTIONS, columnNameOfCorruptRecord=_LINE).csv(path)
    fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    reasons = _reasons(table, columns)
    bad = F.size("_reasons") > 0
    return texts.withColumn("_reasons", reasons).select(
        *[typed_value(c, known.get(c, T.StringType())).alias(c) for c in columns],
        F.when(bad, REJECTED).otherwise(ACCEPTED).alias("_verdict"),
        F.col("_metadata.file_path").alias("_file"),
        "_reasons",
        F.when(bad, F.coalesce(F.col(_LINE), fields)).alias("_record"),
    )


def split_raw(spark: SparkSession, path: str, table: str, target: str) -> None:
    """Write both parts of a raw table to ``target`` in one job; an earlier result goes once it is done."""
    draft = f"{target.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    judged_raw(spark, path, table).write.partitionBy("_verdict").parquet(draft)
    move_into_place(spark, draft, target)


def _both(spark: SparkSession, target: str, table: str) -> DataFrame:
    """Both parts, also where one or both hold nothing."""
    found = spark.read.parquet(target) if _has_rows(spark, target) else None
    if found is None:
        empty = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RAW[table])
        return spark.createDataFrame(
            [], f"{empty}, _verdict string, _file string, _reasons array<string>, _record string"
        )
    return found.withColumn("_verdict", F.col("_verdict").cast("string"))


def _has_rows(spark: SparkSession, target: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(s.isDirectory() for s in fs.listStatus(hadoop_path))


def accepted(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The typed records without fault."""
    return _both(spark, target, table).where(F.col("_verdict") == ACCEPTED).drop(*_OWN)


def rejected(spark: SparkSession, target: str, table: str) -> DataFrame:
    """(file, reasons, record) of every record with a fault."""
    found = _both(spark, target, table).where(F.col("_verdict") == REJECTED)
    return found.select(
        F.col("_file").alias("file"), F.col("_reasons").alias("reasons"), F.col("_record").alias("record")
    )


def quarantine_report(spark: SparkSession, target: str, table: str) -> DataFrame:
    """(reason, n_records): all, accepted, rejected, and by reason (a record may have several)."""
    kinds = F.explode(
        F.concat(F.array(F.lit("all"), F.col("_verdict")), F.col("_reasons"))
    ).alias("reason")
    counted = _both(spark, target, table).select(kinds).groupBy("reason").agg(F.count("*").alias("n_records"))
    always = spark.createDataFrame([("all",), (ACCEPTED,), (REJECTED,)], "reason string")
    return always.join(counted, "reason", "full").select("reason", F.coalesce("n_records", F.lit(0)).alias("n_records"))
