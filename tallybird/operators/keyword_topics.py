"""Topics of texts from a keyword table of any size: one automaton, one pass over every text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallybird.functions.text import fresh_name
from tallybird.sources.workspace import mounted_path, working_folder

BLOCK = 1_000_000  # keywords of one automaton
NO_TOPIC = "General"


@functools.lru_cache(maxsize=1)
def _automaton(folder: str, block: int):
    """The Aho-Corasick automaton of one block of keywords; a worker keeps the last one."""
    import ahocorasick

    rows = ds.dataset(folder, format="parquet").to_table(filter=ds.field("block") == block)
    built = ahocorasick.Automaton()
    for keyword, topics in zip(rows.column("keyword").to_pylist(), rows.column("topics").to_pylist()):
        built.add_word(keyword, topics)
    built.make_automaton()
    return built


@functools.lru_cache(maxsize=1)
def _names(folder: str) -> list[str]:
    rows = ds.dataset(folder, format="parquet").to_table()
    return [name for _, name in sorted(zip(rows.column("number").to_pylist(), rows.column("topic").to_pylist()))]


def keyword_topics(
    docs: DataFrame, keywords: DataFrame, name: str = "topics", text: str = "text", none: str = NO_TOPIC
) -> DataFrame:
    """``docs`` with the array of topics that have a keyword anywhere in the lowered text, also inside
    words; ``[none]`` where there is none, or no text.

    ``keywords`` has (topic, keyword, place): topics are listed by their least place, then by name.
    A keyword may belong to several topics; null or empty ones count for nothing. The table is
    written to the shared folder, and each worker builds the automaton of a block of keywords once; with
    more than ``BLOCK`` keywords a text is passed over once per block.
    """
    spark = docs.sparkSession
    folder = working_folder(spark, "keywords")
    given = keywords.where("topic IS NOT NULL AND keyword <> ''").select("topic", F.lower("keyword").alias("keyword"), "place")
    order = Window.orderBy("place", "topic")  # one row per topic
    topics = given.groupBy("topic").agg(F.min("place").alias("place")).select("topic", (F.row_number().over(order) - 1).alias("number"))
    topics.write.parquet(f"{folder}/topics")
    topics = spark.read.parquet(f"{folder}/topics")
    blocks = max(1, -(-given.count() // BLOCK))
    (
        given.join(topics, "topic")
        .groupBy("keyword")
        .agg(F.collect_set("number").alias("topics"))
        .withColumn("block", F.pmod(F.xxhash64("keyword"), F.lit(blocks)))
        .write.parquet(f"{folder}/keywords")
    )
    place = mounted_path(folder)
    lowered = fresh_name(docs, "lowered_text")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(f"{place}/topics")
        for batch in batches:
            at = batch.schema.names.index(lowered)
            texts = batch.column(at).to_pylist()
            found: list[set[int]] = [set() for _ in texts]
            for block in range(blocks if names else 0):
                automaton = _automaton(f"{place}/keywords", block)
                if not len(automaton):
                    continue
                for own, value in zip(found, texts):
                    for _, numbers in automaton.iter(value or ""):
                        own.update(numbers)
            tags = pa.array([[names[k] for k in sorted(own)] or [none] for own in found], pa.list_(pa.string()))
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, tags], [*(n for n in batch.schema.names if n != lowered), name])

    kept = docs.drop(name)
    schema = StructType([*kept.schema.fields, StructField(name, ArrayType(StringType()))])
    return kept.withColumn(lowered, F.lower(docs[text].cast("string"))).mapInArrow(tag, schema)
