"""Document quality: random-indexing vectors pooled per document, a two-layer network, calibration.

Every row (a word bucket or a word shape) owns a sparse random index vector of +1 and -1. Its word
vector is the sum of the index vectors of its neighbours over the *whole* corpus, counted in one
pass. Word buckets come from the hash of the cased word or run of signs, so the table has a fixed
size whatever the vocabulary; shapes (letters or signs, case, digits, length) carry what buckets of
rare words cannot. A word equal to the one before it is a row of its own kind.

A document is the mean of its word vectors, frequent rows weighing less. A two-layer numpy network
is fitted on at most ``SAMPLE`` labelled documents, the smallest hashes of their ids, on the driver;
a temperature fitted on a fifth of them held back makes its outputs probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallybird.llm.texts import whole_text
from tallybird.llm.tokens import CASED, PIECES, Tokens, random_words, text_slices, tokenise

BUCKETS = 1 << 14
SHAPES = 512
DIM = 32
NONZEROS = 2
REACH = 2  # neighbours on either side
HIDDEN = 32
SAMPLE = 20_000
ACCEPT = 0.7
_ROWS = BUCKETS + SHAPES
_PART = 256  # rows of the table that are summed together
_SLICE = 1 << 20

_draws = random_words(_ROWS * NONZEROS, 53).reshape(_ROWS, NONZEROS)
_PLACE = (_draws % np.uint64(DIM)).astype(np.int64)
_SIGN = np.where((_draws >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))


def _rows_of(data: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of every token: its word bucket and its shape."""
    word = (tokens.hashes >> np.uint64(64 - 14)).astype(np.int64)
    length = tokens.end - tokens.start
    upper, digit = (
        np.concatenate([[0], np.cumsum(mark[data], dtype=np.int32)]) for mark in (_UPPER, _DIGIT)
    )
    capitals = upper[tokens.end] - upper[tokens.start]
    digits = digit[tokens.end] - digit[tokens.start] > 0
    case = np.where(capitals == 0, 0, np.where(capitals == length, 3, np.where(capitals == 1, 1, 2)))
    shape = ((tokens.kind == 2) * 8 + case * 2 + digits) * 16 + np.minimum(length, 15)
    again = np.zeros(len(word), bool)
    again[1:] = tokens.hashes[1:] == tokens.hashes[:-1]
    first = tokens.bounds[:-1]
    again[first[first < len(word)]] = False
    return word, BUCKETS + shape + 256 * again


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbour sums and occurrences of all texts of a task, by part of the table."""
    context = np.zeros(_ROWS * DIM)
    seen = np.zeros(_ROWS)
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0), _SLICE):
            tokens = tokenise(data, offsets, PIECES, CASED)
            owner = np.repeat(np.arange(len(tokens.bounds) - 1), np.diff(tokens.bounds))
            for rows in _rows_of(data, tokens):
                seen += np.bincount(rows, minlength=_ROWS)
                for step in range(1, REACH + 1):
                    near = owner[step:] == owner[:-step]
                    left, right = rows[:-step][near], rows[step:][near]
                    for at, other in ((left, right), (right, left)):
                        for k in range(NONZEROS):
                            context += np.bincount(
                                at * DIM + _PLACE[other, k], _SIGN[other, k], minlength=_ROWS * DIM
                            )
    table = np.concatenate([context.reshape(_ROWS, DIM), seen[:, None]], axis=1).astype(np.int64)
    parts = table.reshape(-1, _PART, DIM + 1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(len(parts), dtype=np.int32)),
            pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
        ],
        names=["part", "sums"],
    )


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(_PART * (DIM + 1), np.int64)
    for value in table.column("sums").to_pylist():
        total += np.frombuffer(zlib.decompress(value), np.int64)
    return pa.table(
        {"part": table.column("part").slice(0, 1), "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())}
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The (rows, DIM) table of weighted unit vectors, counted over every text. Fixed size: 2 MB."""
    summed = (
        docs.select(whole_text(docs, text).alias("t"))
        .mapInArrow(_count, "part int, sums binary")
        .groupBy("part")
        .applyInArrow(_add, "part int, sums binary")
    )
    table = np.zeros((_ROWS, DIM + 1))
    for row in summed.collect():  # _ROWS / _PART rows
        part = np.frombuffer(zlib.decompress(bytes(row["sums"])), np.int64)
        table[row["part"] * _PART : (row["part"] + 1) * _PART] = part.reshape(_PART, DIM + 1)
    vectors, seen = table[:, :DIM], table[:, DIM]
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    for channel in (slice(0, BUCKETS), slice(BUCKETS, _ROWS)):
        share = seen[channel] / max(seen[channel].sum(), 1)
        vectors[channel] *= (1e-3 / (1e-3 + share))[:, None]
    return vectors.astype(np.float32)


def _pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIM): mean vectors of words and of shapes; zeros for a text without words."""
    out = np.zeros((len(column), 2 * DIM))
    for low, _, data, offsets in text_slices(column, _SLICE):
        tokens = tokenise(data, offsets, PIECES, CASED)
        count = np.diff(tokens.bounds)
        filled = np.flatnonzero(count)
        if not len(filled):
            continue
        for k, rows in enumerate(_rows_of(data, tokens)):
            sums = np.add.reduceat(vectors[rows], tokens.bounds[:-1][filled], axis=0, dtype=np.float64)
            out[low + filled, k * DIM : (k + 1) * DIM] = sums / count[filled, None]
    return out


@dataclass
class QualityModel:
    """Word vectors and network; small enough to be shipped with every task (about 2 MB)."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), 0.5)
        logit = _forward((pooled - self.mean) / self.scale, self.layers)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _forward(x, layers):
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, epochs: int = 60, size: int = 256, decay: float = 1e-4):
    """Two layers by Adam on the logistic loss; the same result for the same rows."""
    draw = np.random.default_rng(7)
    params = [
        draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        draw.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(1),
    ]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = draw.permutation(len(x))
        for at in range(0, len(x), size):
            xb, yb = x[order[at : at + size]], y[order[at : at + size]]
            hidden, logit = _forward(xb, params)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - yb) / len(xb)
            back = error[:, None] * params[2] * (1 - hidden**2)
            grads = [xb.T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + decay * params[k] * (k % 2 == 0)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return params[0], params[1], params[2], float(params[3][0])


def fit_network(vectors: np.ndarray, pooled: np.ndarray, label: np.ndarray) -> QualityModel:
    """Without rows of both labels the model answers 0.5 everywhere."""
    if len(set(label.tolist())) < 2:
        return QualityModel(vectors, np.zeros(2 * DIM), np.ones(2 * DIM), None, 1.0)
    mean, scale = pooled.mean(0), pooled.std(0) + 1e-6
    x = (pooled - mean) / scale
    held = np.arange(len(x)) % 5 == 4
    if len(set(label[~held].tolist())) < 2:
        held[:] = False
    layers = _train(x[~held], label[~held])
    temperature = 1.0
    if held.any():
        logit, y = _forward(x[held], layers)[1], label[held]
        trials = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logit / t) - y * logit / t) for t in trials]
        temperature = float(trials[int(np.argmin(loss))])
    return QualityModel(vectors, mean, scale, layers, temperature)


def labelled_sample(labels: DataFrame, label: str, eligible: Column, at_most: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, y) of at most ``at_most`` labelled ids, those with the smallest id hashes. Null ids
    and labels are left out; an id with several labels takes the larger one."""
    return (
        labels.where(labels[doc_id].isNotNull() & labels[label].isNotNull() & eligible)
        .groupBy(labels[doc_id].cast("long").alias("doc_id"))
        .agg(F.max(labels[label].cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(at_most)
    )


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    eligible: Column,
    label: str = "quality",
    sample: int = SAMPLE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> QualityModel:
    """Vectors from all of ``docs``; the network from at most ``sample`` labelled documents for
    which ``eligible`` (a condition on ``labels``) holds."""
    spark = docs.sparkSession
    vectors = word_vectors(docs, text)
    chosen = labelled_sample(labels, label, eligible, sample, doc_id)
    shipped = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = _pool(batch.column("t"), shipped.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array(list(pooled), pa.list_(pa.float64()))],
                names=["id", "y", "x"],
            )

    rows = (
        docs.select(docs[doc_id].cast("long").alias("id"), whole_text(docs, text).alias("t"))
        .join(F.broadcast(chosen), F.col("id") == chosen["doc_id"])  # at most ``sample`` ids
        .select("id", "y", "t")
        .mapInArrow(pool, "id long, y double, x array<double>")
        .orderBy(F.xxhash64("id"), "id", "x")
        .limit(2 * sample)  # an id repeated in docs gives several rows
        .toArrow()
    )
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, 2 * DIM)
    return fit_network(vectors, x, np.array(rows.column("y").to_pylist(), np.float64))


def score_quality(docs: DataFrame, model: QualityModel, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``. A null or empty text is pooled
    to zeros and scored like any other; repeated rows score alike; other columns pass through."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
                column = column.cast(pa.string())
            found = shipped.value.probability(_pool(column, shipped.value.vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
