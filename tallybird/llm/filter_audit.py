"""What filters do to each other: every order of five document filters, replayed per part of the corpus.

Each document becomes a mask of the filters it fails. Masks are counted per part and label, so what is
replayed is a few cells and not documents: every cell folds across the array of orders with higher-order
functions into one weighted struct per order and step, and the structs of a part are summed element by
element. DataFrame functions only.

Filters and when a document fails them (words are runs of anything but ASCII white space):
A fewer than 200 words; B fewer than half of the words are distinct; C more than 2 % of the code points are
A to Z; D one of ``#$%&*|`` occurs; E a smaller id has the same text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybird.llm.texts import whole_text

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
#: Counts of one order and step; ``part`` and the filter follow from the place.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_TWIN = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))

    def mask(words: Column) -> Column:
        n = F.size(words)
        fails = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text))
        bits = [F.when(fail, F.lit(1 << k)).otherwise(0) for k, fail in enumerate((*fails, text.rlike(r"[#$%&*|]")))]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return F.element_at(F.transform(F.array(words), mask), 1)  # words are cut once


def mask_cells(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source"
) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail exactly the filters of ``mask``.

    All texts alike share the bits A to D, so only the smallest id of a text has to be known for E.
    Rows travel as a digest of their text. A document is good (toxic) if any of its label rows has
    quality (toxic) 1. A null id is never the smaller one and has no smaller one.
    """
    body = whole_text(docs, text)
    rows = docs.select(
        docs[key].alias("id"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.sha2(body, 256).alias("digest"),
        text_mask(body).alias("mask"),
    )
    # repeated rows are one before anything is joined, so a frequent id or text is no hot key
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(labels["doc_id"].alias("id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic")
    )
    marked = rows.join(marks, "id", "left").select(
        "id", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    )
    # per text and kind of document: all rows, and the least id with its rows
    kinds = marked.groupBy("digest", "mask", "part", "good", "toxic", F.col("id").isNull().alias("nameless")).agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least")
    )
    same = Window.partitionBy("digest")  # at most 8 rows a part
    first = F.when(F.col("nameless"), F.col("n")).when(F.col("least.id") == F.col("smallest"), F.col("least.n")).otherwise(0)
    split = kinds.withColumn("smallest", F.min("least.id").over(same)).withColumn("first", first)
    either = F.array(
        F.struct(F.col("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + F.lit(_TWIN)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    )
    return (
        split.select("part", "good", "toxic", F.inline(either))
        .groupBy("part", "mask", "good", "toxic")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )


def replay(cell: Column, orders: Column) -> Column:
    """One struct of weighted counts per order and step, as if each document of the cell went through
    the filters in that order."""

    def has(place: Column) -> Column:
        return F.get(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), place).bitwiseAND(cell["mask"]) > 0

    def weighted(hit: Column) -> Column:
        return F.when(hit, cell["n"]).otherwise(F.lit(0).cast("long"))

    def step(state: Column, place: Column) -> Column:
        """``state``: whether the documents are out, and the structs so far."""
        fails, out = has(place), state["out"]
        here = fails & ~out
        counts = F.struct(
            weighted(~fails & ~out).alias("kept"),
            weighted(here).alias("removed"),
            weighted(fails & out).alias("redundant"),
            weighted(fails & (F.bit_count(cell["mask"]) == 1)).alias("unique_fails"),
            weighted(here & (cell["good"] == 1)).alias("good_lost"),
            weighted(here & (cell["toxic"] == 1)).alias("toxic_lost"),
        )
        return F.struct((out | fails).alias("out"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    none = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")

    def through(order: Column) -> Column:
        start = F.struct(F.lit(False).alias("out"), none.alias("steps"))
        return F.aggregate(order, start, step, lambda state: state["steps"])

    return F.flatten(F.transform(orders, through))


def audit_filters(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source"
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley):
    600 rows per part, zeros included.

    A null text is empty, a null part the empty string, and both count; labels without a document and
    columns of other names change nothing. An empty table has no parts and gives no rows.
    """
    cells = mask_cells(docs, labels, text, key, part)
    orders = F.lit([[FILTERS.index(f) for f in order] for order in ORDERS])
    # at most 32 masks x 4 kinds of document in a part: a bounded group
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    zeros = F.array_repeat(
        F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS)
    )

    def add(left: Column, right: Column) -> Column:
        return F.struct(*[(left[c] + right[c]).alias(c) for c in COUNTS])

    summed = F.aggregate("cells", zeros, lambda total, cell: F.zip_with(total, replay(cell, F.col("orders")), add))
    rows = parts.select("part", "cells", orders.alias("orders")).select("part", F.posexplode(summed).alias("place", "c"))
    order = F.get(F.lit(ORDERS), F.floor(F.col("place") / len(FILTERS)).cast("int"))
    step = (F.col("place") % len(FILTERS) + 1).cast("int")
    rows = rows.select("part", order.alias("filter_order"), step.alias("step"), "c.*")
    letter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows
    return rows.withColumn("shapley", F.sum("removed").over(letter))
