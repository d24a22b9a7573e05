"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

DataFrame functions only. Within a source, documents are ordered by the MD5 of their id: a random
order that every run repeats. Equal ranges of that key are the buckets of a range sort: they are even
because the key is, and their number follows the source's rows, so a source with a third of all rows
is many buckets. Sizes are summed within buckets and the buckets are chained by their totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybird.llm.staging import staged
from tallybird.llm.texts import whole_text

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 2000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, rows, source_size, target) from (source, rows, source_size), one row per source.

    Weights go round the sources in code-point order, null last. Targets share ``share`` of all
    sizes by weight; none exceeds ``most`` times its source's size, the excess is shared again. In
    order of room per weight the level of sharing first rises, while sources fill up, then falls:
    its highest value is the level at which the sources left over share. One row per source is
    ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weighed = sizes.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")),
    ).withColumn("room", F.lit(float(most)) * F.col("source_size"))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - (F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - F.col("room"))
    ) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "rows", "source_size", F.least("room", F.col("level") * F.col("weight")).alias("target"))
    )


def mix_sources(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row per row of ``docs``: a struct ``row`` of the columns ``keep``, size, source_size,
    target (its source's) and taken: the words the mix takes of it, repeats counted.

    A source goes through whole epochs while its target lasts; the last epoch takes documents in
    hash order until the budget ends, the last one in part. So a source's taken words are the whole
    part of its target. Null text has size 0 and is never taken; null source is a source of its own;
    a null id is ordered by its text; rows that agree in id and size may swap places, which changes
    no result. An empty table gives an empty one; if all sizes are 0 all targets are.
    """
    # the null source gets a name no source has: joins and windows then treat it like any other
    key = F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit(""))
    sized = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("row"),
        key.alias("skey"),
        F.md5(F.coalesce(docs[doc_id].cast("string"), whole_text(docs, text)).cast("binary")).alias("draw"),
        word_count(docs[text].cast("string")).alias("size"),
    )
    sized = staged(sized, "sized")
    sizes = (
        sized.groupBy("skey")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
        .withColumn("source", F.when(F.col("skey") != "", F.expr("substring(skey, 2)")))
    )
    targets = staged(
        source_targets(sizes.drop("skey"), weights, share, most).select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"),
            F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"),
            "source_size",
            "target",
        ),
        "targets",
    )
    first_bits = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    placed = sized.join(targets, "skey").withColumn(
        "bucket", F.shiftright(first_bits * F.col("buckets"), 32)
    )
    chained = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = staged(
        placed.groupBy("skey", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("skey", "bucket", (F.sum("words").over(chained) - F.col("words")).alias("earlier")),
        "buckets",
    )
    within = (
        Window.partitionBy("skey", "bucket").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    upto = placed.withColumn("inside", F.sum("size").over(within) - F.col("size")).join(before, ["skey", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    last = F.floor(F.col("target") - epochs * F.col("source_size"))
    part = last - F.col("earlier") - F.col("inside")
    return upto.select(
        "row",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))).cast("long").alias("taken"),
    )
