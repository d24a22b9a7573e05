from __future__ import annotations

import random

import numpy as np
import pytest

from tallybird.llm.quality import DIM, fit_network, fit_quality, labelled_sample, score_quality, word_vectors
from tallybird.llm.texts import remainder


def corpus(n, seed):
    """Good documents are prose; bad ones shout, are cut by bars, or repeat a word."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("aeioustrnl") for _ in range(draw.randrange(2, 9))) for _ in range(400)]
    rows = []
    for k in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(20, 120))]
        kind = draw.randrange(6)
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " | ".join(words)
        elif kind == 2:
            text = " ".join(w for w in words[:5] for _ in range(15))
        else:
            text = ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        rows.append((k, text, int(kind > 2)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900, 1)
    odd = [(None, "A text without an id."), (5000, None), (5001, ""), (5002, "x " * 50000), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(*r, None) for r in odd], "doc_id long, text string, y string")
    labels = spark.createDataFrame(
        [(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (4, None, 0), (7, 1, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int"
    )
    return docs, labels, {i: q for i, _, q in rows}


def test_held_out_accuracy_and_odd_rows(spark, tables):
    docs, labels, truth = tables
    model = fit_quality(docs, labels, remainder(labels["doc_id"], 4) != 2)
    scored = score_quality(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    found = scored.join(docs.select("doc_id", remainder(docs["doc_id"], 4).alias("r")).distinct(), "doc_id", "left").collect()
    assert scored.count() == docs.count()
    held = [(r["score"], truth[r["doc_id"]]) for r in found if r["r"] == 2 and r["doc_id"] in truth]
    assert len(held) > 100
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    again = fit_quality(docs, labels, remainder(labels["doc_id"], 4) != 2)
    assert np.allclose(again.vectors, model.vectors)


def test_nothing_to_learn_from(spark, tables):
    docs, labels, _ = tables
    model = fit_quality(docs, labels, labels["quality"] == 1)  # one label only
    assert {r["score"] for r in score_quality(docs.limit(5), model).collect()} == {0.5}
    empty = docs.limit(0)
    model = fit_quality(empty, labels, labels["quality"] >= 0)
    assert score_quality(empty, model).collect() == []


def test_the_sample_is_bounded_and_stable(spark, tables):
    _, labels, _ = tables
    first = labelled_sample(labels, "quality", labels["doc_id"] >= 0, 50).collect()
    assert len(first) == 50 and first == labelled_sample(labels.repartition(7), "quality", labels["doc_id"] >= 0, 50).collect()


def test_vectors_do_not_depend_on_the_partitions(spark, tables):
    docs = tables[0].select("text")
    assert np.array_equal(word_vectors(docs.repartition(5)), word_vectors(docs.coalesce(1)))


def test_temperature_calibrates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(12000, 2 * DIM))
    y = (draw.random(12000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    p = fit_network(np.zeros((1, DIM), np.float32), x[:8000], y[:8000]).probability(x[8000:])
    fresh = y[8000:]
    for low in (0.2, 0.4, 0.6):
        inside = (p >= low) & (p < low + 0.2)
        assert abs(p[inside].mean() - fresh[inside].mean()) < 0.12
