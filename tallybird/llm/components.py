"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybird.llm.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = staged(least, "least")  # both sides of the join are then shuffled, and a hot node is split
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node without any: the roots are found."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    by_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return by_node.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that ``edges`` (two long columns a, b) links with another: root is
    the least node of its component.

    Every round is a few aggregates and joins over the edges, whose number never grows; a node with
    very many neighbours is pre-aggregated for its least neighbour, and its rows in the join can be
    split. Rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder; the driver learns only whether it was the last. Loops and repeated edges are allowed; an
    empty table gives an empty table.
    """
    ordered = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = staged(ordered.distinct(), "edges")
    while not _are_stars(now):
        now = staged(_small_star(staged(_large_star(now), "edges")), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
