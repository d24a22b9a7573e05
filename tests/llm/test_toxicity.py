from __future__ import annotations

import random

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallybird.llm import toxicity
from tallybird.llm.texts import remainder
from tallybird.llm.tokens import text_slices
from tallybird.llm.toxicity import (
    LEXICON,
    POOLS,
    SINGLE,
    VOTERS,
    LabelModel,
    Voters,
    dealt,
    features,
    find_voters,
    fit_label_model,
    fit_linear,
    packed,
    score_toxicity,
    unpacked,
)

BAD = ["zounds", "knave", "varlet", "scullion", "poltroon"]
SCHEMA = "doc_id long, text string, votes string"


def corpus(n, seed):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("aeioustrnl") for _ in range(draw.randrange(2, 9))) for _ in range(600)]
    rows = []
    for k in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(10, 150))]
        toxic = draw.random() < 0.15
        if toxic:
            for _ in range(draw.randrange(2, 6)):
                if k % 3:
                    words.insert(draw.randrange(len(words)), draw.choice(BAD))
                else:  # a word of its own each time, with a beginning in common
                    words.insert(draw.randrange(len(words)), "grumbl" + draw.choice(vocabulary))
        rows.append((k, " ".join(words).capitalize(), int(toxic)))
    return rows


def test_held_out_documents_and_odd_rows(spark):
    rows = corpus(1500, 2)
    odd = [(None, "Some text without id"), (6000, None), (6001, ""), (6002, "word " * 60000), (6003, "you KNAVE, you Varlet!"), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "v") for i, t, _ in rows] + [(*r, None) for r in odd], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    found = score_toxicity(docs, labels, remainder(labels["doc_id"], 5) != 0)
    assert found.columns == ["doc_id", "score"] and found.count() == docs.count()
    found = found.withColumn("r", remainder(found["doc_id"], 5)).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r["score"] >= 0.5, truth[r["doc_id"]]) for r in found if r["r"] == 0 and r["doc_id"] in truth]
    caught = [p for p, y in held if y]
    wrong = [p for p, y in held if not y]
    assert len(caught) > 20 and np.mean(caught) > 0.9 and np.mean(wrong) < 0.02
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[6003] >= 0.5 and max(by_id[6000], by_id[6001], by_id[6002], by_id[None]) < 0.5


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in score_toxicity(docs, labels, labels["doc_id"] >= 0).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), labels, labels["doc_id"] >= 0).collect() == []


def test_repeated_voters_count_less():
    ill, well = np.full(VOTERS, 0.5), np.full(VOTERS, 0.5)
    ill[:2], well[:2] = 0.9, 0.1
    votes = np.zeros((1, VOTERS), bool)
    votes[0, :2] = True
    alone = LabelModel(ill, well, 0.5, np.ones(VOTERS)).posterior(votes)[0]
    shared = LabelModel(ill, well, 0.5, np.where(np.arange(VOTERS) < 2, 0.5, 1.0)).posterior(votes)[0]
    assert abs(alone - 81 / 82) < 1e-6 and abs(shared - 9 / 10) < 1e-6


def test_votes_survive_packing():
    votes = np.random.default_rng(1).random((7, VOTERS)) < 0.3
    assert (unpacked(packed(votes)) == votes).all()
    assert unpacked(packed(votes[:0])).shape == (0, VOTERS)


def test_linear_classifier_learns_soft_labels():
    draw = np.random.default_rng(2)
    votes = draw.random((3000, VOTERS)) < 0.1
    target = 1 / (1 + np.exp(-(4.0 * votes[:, 0] + 4.0 * votes[:, 1] - 2.0)))
    w = fit_linear(votes, target, np.ones(3000))
    found = 1 / (1 + np.exp(-(votes @ w[:-1] + w[-1])))
    assert np.abs(found - target).mean() < 0.05


def of_text(text):
    (_, _, data, offsets), = text_slices(pa.array([text]))
    found, _, words = features(data, offsets)
    return Counter(found.tolist()), int(words[0])


def test_votes_against_counting_text_by_text():
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{k}ord" for k in draw.integers(0, 900, n)) for n in (3, 40, 400, 0, 2000)] + ["", "w1ord " * 30]
    keys = np.unique(np.array(list(set().union(*(of_text(t)[0] for t in texts))), np.uint64))[::2]
    rate = draw.random(len(keys)) / 500
    voter = draw.integers(0, LEXICON, len(keys))
    voters = Voters(keys, rate, voter, np.zeros(VOTERS), np.zeros(VOTERS), 0.0, 0)
    got = voters.votes(pa.array(texts))
    for text, row in zip(texts, got):
        held, words = of_text(text)
        fired = {k: held[int(key)] for k, key in enumerate(keys) if held[int(key)] > 3 * words * rate[k]}
        places = {int(voter[k]) for k in fired}
        times = sum(fired.values())
        patterns = (len(places) >= 4, len(places) >= 8, times >= 12, times * 100 >= words, times * 25 >= words)
        wanted = places | {LEXICON + k for k, p in enumerate(patterns) if p and places}
        assert set(np.flatnonzero(row).tolist()) == wanted
    assert got.any()


def test_every_feature_has_a_voter():
    draw = np.random.default_rng(6)
    sums, sure = draw.integers(4, 40, (3000, 3)), np.empty(3000)
    sure[:] = sums[:, 0] - sums[:, 1] / 100
    voter = dealt(sums, sure)
    assert voter.min() == 0 and voter.max() == LEXICON - 1
    assert len(set(voter[voter >= SINGLE].tolist())) == POOLS
    assert sure[voter < SINGLE].min() >= sure[voter >= SINGLE].max()
    same = {}
    for row, v in zip(map(tuple, sums.tolist()), voter.tolist()):
        assert same.setdefault(row, v) == v
    assert sorted(dealt(sums[:3], sure[:3]).tolist()) == [0, 1, 2]


def test_features_beyond_the_single_voters_count(spark, monkeypatch):
    rows = corpus(1200, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.col("y").alias("toxic"))
    everyone = find_voters(docs, labels, F.lit(True), "toxic", 10_000, "doc_id", "text")
    monkeypatch.setattr(toxicity, "SINGLE", 2)
    pooled = find_voters(docs, labels, F.lit(True), "toxic", 10_000, "doc_id", "text")
    assert (pooled.keys == everyone.keys).all() and len(pooled.keys) > 20
    known = set(everyone.keys.tolist())
    for word in BAD:
        assert known & set(of_text(word)[0])


def test_em_against_one_row_per_document(spark):
    draw = np.random.default_rng(7)
    ill, well = draw.uniform(0.01, 0.5, VOTERS), draw.uniform(0.001, 0.05, VOTERS)
    toxic = draw.random(400) < 0.3
    votes = draw.random((400, VOTERS)) < np.where(toxic[:, None], ill, well)
    votes[:, 1] = votes[:, 0]  # voters that repeat each other
    votes[200:300] = votes[100:200]  # and copies of documents
    start = Voters(np.ones(1, np.uint64), np.ones(1), np.zeros(1, int), np.clip(ill * 0.8, 0.01, 1), well + 0.01, 0.2, 50)
    data = spark.createDataFrame([(bytes(b),) for b in packed(votes).to_pylist()], "votes binary")
    got = fit_label_model(data.groupBy("votes").agg(F.count("*").alias("n")), start, rounds=3)

    x = votes.astype(float)
    model = (start.ill, start.well, start.prior, np.ones(VOTERS))
    for k in range(3):
        p1, p0, prior, share = model
        one = np.log(prior) + (share * np.where(votes, np.log(p1), np.log1p(-p1))).sum(1)
        none = np.log1p(-prior) + (share * np.where(votes, np.log(p0), np.log1p(-p0))).sum(1)
        p = 1 / (1 + np.exp(np.clip(none - one, -30, 30)))
        if k == 0:
            tied, whole = np.zeros((VOTERS, VOTERS)), 0.0
            for w in (p, 1 - p):
                mean = (w @ x) / w.sum()
                spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
                pairs = (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
                tied += (w @ x).sum() * pairs / np.outer(spread, spread)
                whole += (w @ x).sum()
            tied = np.clip(tied / whole, 0, 1) * (1 - np.eye(VOTERS))
            share = 1 / (1 + np.where(tied > 0.1, tied, 0).sum(1))
        a, b = 50 * start.prior, 50 * (1 - start.prior)
        model = ((p @ x + a * start.ill) / (p.sum() + a), ((1 - p) @ x + b * start.well) / ((1 - p).sum() + b),
                 (p.sum() + a) / (450), share)
    for ours, theirs in zip((got.ill, got.well, got.prior, got.share), model):
        assert np.allclose(ours, np.clip(theirs, 0, 1), atol=1e-9)
