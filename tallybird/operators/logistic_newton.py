"""Logistic regression by Newton steps on sums that Spark gathers, with the proof that it is the optimum."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 50
TOLERANCE = 1e-10  # of the mean penalised gradient


@dataclass(frozen=True)
class Logistic:
    """Coefficients for centred and scaled columns, the level last."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    gradient: float  # norm of the mean penalised gradient at ``beta``
    steps: int


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Weighted loss, gradient and Hessian over all rows: one row of sums per task, summed by place."""
    d = len(beta)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + d * d)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d - 1))
            x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            z = x @ beta
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[0] += np.sum(w * (np.logaddexp(0, z) - y * z))
            total[1 : 1 + d] += x.T @ (w * (p - y))
            total[1 + d :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    summed = rows.mapInArrow(partial, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(1 + d + d * d)
    for row in summed.collect():  # as many as the columns allow, whatever the rows
        out[row["place"]] = row["value"]
    return out


def fit_newton(
    train: DataFrame, columns: Sequence[str], label: str = "churned", penalty: float = 1.0, balanced: bool = True
) -> Logistic:
    """The minimum of the summed (balanced) logistic loss plus ``penalty`` / 2 times the squares of all
    coefficients but the level, over centred columns of deviation 1; a constant column is only centred.

    Each step is one pass over ``train``, which should be written down. NULLs count as the column's mean.
    Without rows of both labels there is nothing to fit: an error.
    """
    columns = list(columns)
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"labels {sorted(map(str, counts))}; both 0 and 1 are needed")
    n = sum(counts.values())
    about = train.agg(
        *[F.avg(f"`{c}`").alias(f"m{k}") for k, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{k}") for k, c in enumerate(columns)],
    ).first()
    mean = np.array([about[f"m{k}"] or 0.0 for k in range(len(columns))], float)
    scale = np.array([about[f"s{k}"] or 1.0 for k in range(len(columns))], float)
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(m))) for c, m in zip(columns, mean)]
    rows = train.select(F.array(*filled).alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w"))
    ridge = np.append(np.full(len(columns), penalty), 0.0)
    beta, step, loss = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1), np.inf
    for steps in range(1, MAX_STEPS + 1):
        sums = _sums(rows, mean, scale, beta + step)
        now = sums[0] + 0.5 * np.sum(ridge * (beta + step) ** 2)
        if now > loss * (1 + 1e-12) + 1e-9:  # too far: half the way
            step = step / 2
            continue
        beta, loss, d = beta + step, now, len(beta)
        slope = sums[1 : 1 + d] + ridge * beta
        norm = float(np.linalg.norm(slope) / n)
        if norm < TOLERANCE:
            break
        step = -np.linalg.solve(sums[1 + d :].reshape(d, d) + np.diag(ridge + 1e-12), slope)
    return Logistic(columns, mean, scale, beta, norm, steps)


def newton_probability(model: Logistic) -> Column:
    """The probability of label 1 as a column expression."""
    z = F.lit(float(model.beta[-1]))
    for c, m, s, b in zip(model.columns, model.mean, model.scale, model.beta):
        z = z + (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(m))) - float(m)) * float(b / s)
    return 1 / (1 + F.exp(-z))
