from __future__ import annotations

import math
import random

import pytest

from tallybird.llm import topk
from tallybird.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, every):
    def weights(x):
        if x is None or any(v is None or not math.isfinite(v) for v in x):
            return None
        return [math.floor(64 * v) for v in x]

    usable = [(i, w) for i, w in ((i, weights(x)) for i, x in rows) if w is not None]
    out = []
    for a, (query, q) in enumerate(usable):
        if query is None or query % every:
            continue
        best = sorted((-sum(x * y for x, y in zip(q, c)), i is None, i or 0) for b, (i, c) in enumerate(usable) if b != a)
        out += [(query, n + 1, None if empty else i, -s) for n, (s, empty, i) in enumerate(best[:k])]
    return sorted(out, key=repr)


def check(spark, rows, k=20, every=20):
    vectors = spark.createDataFrame([(i, x, 7) for i, x in rows], SCHEMA)
    found = exact_top_k(vectors, k, every)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, k, every)


def vector(draw, n=8):
    return [draw.choice([-0.5, -0.25, 0.0, 0.125, 0.5]) for _ in range(n)]


def test_ties_repeats_nulls_and_odd_lengths(spark):
    draw = random.Random(1)
    rows = [(k, vector(draw)) for k in range(90)]
    rows += [(3, rows[3][1]), (20, rows[20][1]), (20, vector(draw)), (None, rows[5][1]), (None, None), (200, None), (220, [0.5, None]),
             (240, [float("nan")] * 8), (260, [float("inf")] * 8), (280, []), (300, [1.0] * 12), (320, [0.25] * 3), (-20, vector(draw))]
    check(spark, rows)


def test_fewer_rows_than_asked_for_and_none(spark):
    draw = random.Random(2)
    check(spark, [(0, vector(draw)), (1, vector(draw)), (20, vector(draw))])
    check(spark, [(0, vector(draw))])
    check(spark, [(1, vector(draw))])
    check(spark, [])


def test_many_blocks_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    draw = random.Random(3)
    common = vector(draw)
    check(spark, [(k, common if k % 3 == 0 else vector(draw)) for k in range(400)], k=5)


@pytest.mark.parametrize("size", [1.0, 1000.0, 3e7])
def test_large_components_do_not_overflow(spark, size):
    draw = random.Random(4)
    check(spark, [(k, [v * size for v in vector(draw, 4)]) for k in range(45)], k=4)
