from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallybird.llm import ngram_join
from tallybird.llm.components import components
from tallybird.llm.ngram_join import BLOCK, bands_for, drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, node string, n_links int"  # two names that the operator uses itself


def gram_set(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    """[(doc_id, class_id, n_links)] by comparing all pairs."""
    sets = [gram_set(t) for _, t in rows]
    linked = [
        [j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        for i in range(len(rows))
    ]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(linked):
            low = min([label[i], *(label[j] for j in own)])
            changed |= low < label[i]
            label[i] = low
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, (min(ids) if ids else None) if sets[i] else doc_id, len(linked[i])))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    found = near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)
    return docs


def words(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def changed(text, places, seed):
    draw, out = random.Random(seed), text.split()
    for _ in range(places):
        out[draw.randrange(len(out))] = f"c{draw.randrange(10**9)}"
    return " ".join(out)


def test_copies_near_copies_and_odd_rows(spark):
    base, other, long = " ".join(words(1, 120)), " ".join(words(2, 90)), " ".join(words(3, 30000))
    rows = [
        (7, base), (3, base), (3, base), (9, changed(base, 2, 1)), (10, changed(base, 2, 2)), (11, changed(base, 40, 3)),
        (20, other), (21, other.upper()), (22, other.replace(" ", "\n\t ")), (23, other + " tail"),
        (30, long), (31, changed(long, 900, 4)), (None, base), (None, "all alone here with a null id"), (None, None),
        (40, None), (41, ""), (42, " \t "), (43, ""), (50, "two words"), (51, "two words"), (52, "two  words"), (53, "two"),
        (60, "a b c d e"), (61, "A b c d e"), (62, "a b c d f"),
    ]
    docs = check(spark, rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([3, 11, 20, 30, 31, None, None, 40, 41, 42, 43, 50, 53, 60, 62], key=repr)


def test_group_larger_than_a_block(spark):
    base = " ".join(words(5, 150))
    rows = [(k, changed(base, k % 4, k)) for k in range(3 * BLOCK)] + [(1000 + k, base) for k in range(40)]
    check(spark, rows)


def windows(shifts, size=64):
    """Texts that are windows of one long text, each moved on by the next shift."""
    text, at, out = words(6, sum(shifts) + size), 0, []
    for shift in [0, *shifts]:
        at += shift
        out.append(" ".join(text[at : at + size]))
    return out


def test_buckets_of_a_chained_component(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    seen = []
    plain = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda nodes: seen.append(plain(nodes)) or seen[-1])
    base = " ".join(words(8, 100))
    texts = windows([5, 10] * 60) + [changed(base, k % 3, k) for k in range(20)]
    check(spark, [(3 * k, t) for k, t in enumerate(texts)] + [(1, texts[0]), (None, texts[7])])
    ways = {r["by_bucket"] for r in seen[0].select("by_bucket").collect()}
    assert True in ways


def test_chains_do_not_meet_in_all_pairs(spark):
    chain = windows([7] * 3000)  # neighbours share 53 of 67 n-grams: candidates, no links
    bands, n = bands_for(), len(chain)
    rows = spark.createDataFrame(list(enumerate(chain)), "node long, t string").withColumn("doc_id", F.col("node"))
    signed = rows.select("doc_id", "t", "node").mapInArrow(
        ngram_join._signatures(bands, ngram_join.ROWS, 5), "doc_id long, node long, bands array<long>"
    )
    found = ngram_join.candidates(signed.select("node", "bands"))
    units = found.select("by_bucket", F.inline("units"))
    sent = units.agg(F.sum("blocks")).first()[0]
    assert sent <= bands * n  # every node in as many groups as it has bands, at most
    largest = found.select(F.inline("units")).agg(F.max("blocks")).first()[0]
    assert found.where("by_bucket").count() > n / 2 and largest <= 12


def test_rows_of_a_small_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).collect() == []
    assert drop_near_duplicates(docs).collect() == []


@pytest.mark.parametrize("rows", [3, 6, 8])
def test_bands_reach_the_recall(rows):
    bands = bands_for(0.8, rows, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200 + k) for k in range(50)] + [(300, 300), (400, 401), (401, 400)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    wanted = {k: 0 for k in range(31)} | {100: 100} | {200 + k: 100 for k in range(50)} | {400: 400, 401: 400}
    assert {r["node"]: r["root"] for r in found} == wanted and len(found) == len(wanted)
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).collect() == []
