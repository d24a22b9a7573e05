"""Isolation forest (Liu, Ting & Zhou 2008) with trees grown and rows scored in parallel."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.stats import exact_quantiles, one_row

# The published defaults and the share of rows to flag.
TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.05, 42
ANOMALY, NORMAL = "Anomaly", "Normal"

_NODE = "tree int, node int, feature int, threshold double, left int, right int, depth double"
_HASH_RANGE = 2**40


def standardised(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(key, x): metrics with NULL as 0, centred and scaled to unit population deviation."""
    filled = df.select(key, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m)
                              for m in metrics])
    fit = one_row(
        filled,
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
    )

    def scaled(m: str) -> Column:
        spread = F.coalesce(F.nullif(F.col(f"_fit.{m}_std"), F.lit(0.0)), F.lit(1.0))
        return (F.col(m) - F.col(f"_fit.{m}_mean")) / spread

    return filled.withColumn("_fit", fit).select(key, F.array(*map(scaled, metrics)).alias("x"))


def _samples(rows: DataFrame, key: str, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows drawn for each tree, about 1.3 times as many as it needs. Each row draws its trees
    where it lies, so only the draws are shuffled: trees * sample rows however large the table."""
    limit = int(min(1.0, 1.3 * sample / max(n, 1)) * _HASH_RANGE)
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(_HASH_RANGE)) < limit,
    )
    return rows.select(F.explode(drawn).alias("tree"), key, "x").withColumn(
        "_draw", F.xxhash64(F.col("tree"), F.col(key), F.lit(seed + 1))
    )


def _mean_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n keys."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _grow(sample: int, seed: int):
    height = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        pdf = pdf.sort_values("_draw").head(sample)  # the tree's sample, in a fixed order
        x = np.stack(pdf["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        used = 1
        while todo:
            node, rows, depth = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth == height or len(open_features) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + _mean_depth(len(rows))))
                continue
            feature = int(rng.choice(open_features))
            threshold = rng.uniform(low[feature], high[feature])
            goes_left = x[rows, feature] <= threshold
            nodes.append((tree, node, feature, threshold, used, used + 1, float(depth)))
            todo += [(used, rows[goes_left], depth + 1), (used + 1, rows[~goes_left], depth + 1)]
            used += 2
        names = ["tree", "node", "feature", "threshold", "left", "right", "depth"]
        return pd.DataFrame(nodes, columns=names)

    return grow


def _scorer(key: str, nodes: pd.DataFrame, sample: int):
    forest = [
        group.sort_values("node")[["feature", "threshold", "left", "right", "depth"]]
        for _, group in nodes.groupby("tree")
    ]
    forest = [tuple(group[c].to_numpy() for c in group.columns) for group in forest]
    usual = _mean_depth(sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].to_numpy())
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, threshold, left, right, depth in forest:
                at = np.zeros(len(x), dtype=int)
                while (inner := feature[at] >= 0).any():
                    below = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                total += depth[at]
            yield pd.DataFrame(
                {key: pdf[key], "score": 2.0 ** (-total / len(forest) / max(usual, 1e-9))}
            )

    return score


def isolation_scores(
    df: DataFrame,
    key: str,
    metrics: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """(key, score): the higher, the easier a row is to isolate.

    The driver receives the row count and the fitted trees, at most ``trees * (2 * sample - 1)``
    nodes whatever the size of the table; the rows stay where they are. ``key`` must be unique:
    draws and splits depend on it and not on how the table is partitioned.
    """
    rows = standardised(df, key, metrics)
    n = df.count()
    if n == 0:
        return rows.select(key, F.lit(0.0).alias("score"))
    drawn = _samples(rows, key, n, trees, sample, seed)
    nodes = drawn.groupBy("tree").applyInPandas(_grow(min(sample, n), seed), _NODE).toPandas()
    schema = f"{key} {df.schema[key].dataType.simpleString()}, score double"
    return rows.mapInPandas(_scorer(key, nodes, min(sample, n)), schema)


def isolation_flags(
    df: DataFrame, scores: DataFrame, key: str, contamination: float = CONTAMINATION
) -> DataFrame:
    """``df`` with ``isolation_score`` and ``isolation_forest_flag``: the highest scores, in the
    share given, are anomalies."""
    limit = exact_quantiles(scores, "score", [1 - contamination]).select(
        F.element_at("q", 1).alias("limit")
    ).scalar()
    flagged = scores.withColumn("_limit", limit).select(
        key,
        F.col("score").alias("isolation_score"),
        F.when(F.col("score") > F.col("_limit"), ANOMALY).otherwise(NORMAL)
        .alias("isolation_forest_flag"),
    )
    return df.join(flagged, key)
