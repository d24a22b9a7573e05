from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallybird.llm import decontaminate
from tallybird.llm.decontaminate import ItemIndex, drop_contaminated, find_items, least_edits, max_edits
from tallybird.llm.tokens import LETTERS, LOWER, random_words, tokenise


def words(text):
    return [w for w in re.split(r"[\W]+", (text or "").lower()) if w]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def holds(text, item):
    """Every run of about the item's length, one by one."""
    own, slack = words(item), max_edits(len(words(item)))
    doc = words(text)
    return bool(own) and any(
        edits(own, doc[a : a + n]) <= slack
        for a in range(len(doc))
        for n in range(max(1, len(own) - slack), len(own) + slack + 1)
        if a + n <= len(doc)
    )


def prose(draw, n):
    return [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.randrange(300)}" for _ in range(n)]


def edited(draw, item, n):
    out = list(item)
    for at in sorted(draw.sample(range(len(out)), n), reverse=True):
        kind = draw.randrange(3)
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "added")
    return out


def test_against_all_runs(spark):
    draw = random.Random(4)
    items = [(k, " ".join(prose(draw, n))) for k, n in enumerate([3, 5, 9, 15, 24, 40])]
    items += [(10, items[3][1]), (11, ""), (12, None), (13, "..."), (None, " ".join(prose(draw, 12)))]
    rows = []
    for _, item in items:
        own = (item or "x").split()
        for n in {0, max_edits(len(own)), max_edits(len(own)) + 2} & set(range(len(own) + 1)):
            text = prose(draw, 20) + edited(draw, own, n) + prose(draw, 7)
            rows.append((len(rows), " ".join(text), "z"))
        rows.append((len(rows), ", ".join(own).upper() + "!", None))
    rows += [(100, None, None), (101, "", ""), (102, " ".join(prose(draw, 20000) + items[4][1].split()), "q"), (None, items[2][1], "n"), (0, rows[0][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_items(docs, benchmark).collect()
    wanted = {}
    for i, text, _ in rows:
        if len(words(text)) < 1000:
            wanted[text] = sorted({k for k, item in items if holds(text, item)}, key=lambda x: (x is None, x))
    missed = 0
    for row in found:
        if row["text"] in wanted:
            extra = set(row["item_ids"]) - set(wanted[row["text"]])
            assert not extra
            missed += len(wanted[row["text"]]) - len(row["item_ids"])
        elif row["doc_id"] == 102:
            assert row["item_ids"] == [4]
    assert missed == 0
    kept = drop_contaminated(docs, benchmark)
    assert kept.schema == docs.schema
    assert kept.count() == sum(not r["item_ids"] for r in found)


def test_recall_near_the_limit():
    draw = random.Random(5)
    items = [prose(draw, draw.randrange(15, 60)) for _ in range(60)]
    index = ItemIndex()

    def hashes(own):
        data = np.frombuffer(" ".join(own).encode(), np.uint8)
        return tokenise(data, np.array([0, len(data)]), LETTERS, LOWER).hashes

    for k, own in enumerate(items):
        index.ids.append(k)
        index.words.append(hashes(own))
    index.build()
    found = {0.1: 0, 0.2: 0}
    for rate in found:
        for trial in range(300):
            k = trial % len(items)
            own = hashes(prose(draw, 15) + edited(draw, items[k], int(rate * len(items[k]))) + prose(draw, 15))
            found[rate] += k in index.search(own, np.array([0, len(own)])).get(0, set())
    assert found[0.1] >= 297 and found[0.2] >= 285


def retrieved(draw, n, trials, change):
    """Share of documents that hold a changed item of ``n`` words in which it is found."""
    found = 0
    for _ in range(trials):
        item = prose(draw, n)
        data = [np.frombuffer(" ".join(x).encode(), np.uint8) for x in (item, prose(draw, 15) + change(item) + prose(draw, 15))]
        item, doc = (tokenise(x, np.array([0, len(x)]), LETTERS, LOWER).hashes for x in data)
        index = ItemIndex(ids=[0], words=[item]).build()
        found += 0 in index.search(doc, np.array([0, len(doc)])).get(0, set())
    return found / trials


@pytest.mark.parametrize("n", [*range(1, 31), 35, 40])
def test_recall_at_the_limit_for_each_length(n):
    draw = random.Random(n)
    slack = max_edits(n)

    def substituted(item):
        at = set(draw.sample(range(n), slack))
        return ["changed" if k in at else w for k, w in enumerate(item)]

    least = 1.0 if n <= decontaminate.SHORT else 0.9
    assert retrieved(draw, n, 60, lambda item: edited(draw, item, slack)) >= least
    assert retrieved(draw, n, 60, substituted) >= least
    if n <= decontaminate.SHORT:
        for first in range(5):  # edits as far apart as they can be
            at = range(first, n, 5)[:slack]
            assert retrieved(draw, n, 20, lambda item: ["changed" if k in at else w for k, w in enumerate(item)]) == 1


@pytest.mark.parametrize("seed", range(20))
def test_least_edits(seed):
    draw = random.Random(seed)
    item = [draw.randrange(4) for _ in range(draw.randrange(1, 9))]
    region = [draw.randrange(4) for _ in range(draw.randrange(0, 14))]
    best = min(edits(item, region[a:b]) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
    assert least_edits(np.array(item, np.uint64), np.array(region, np.uint64)) == best


def test_blocks_of_the_benchmark_and_empty_tables(spark, monkeypatch):
    draw = random.Random(6)
    items = [(k, " ".join(prose(draw, 12))) for k in range(7)]
    docs = spark.createDataFrame([(k, t) for k, t in items] + [(9, " ".join(prose(draw, 30)))], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert {r["doc_id"]: r["item_ids"] for r in find_items(docs, benchmark).collect()} == {k: [k] for k in range(7)} | {9: []}
    assert find_items(docs.limit(0), benchmark).collect() == []
    assert all(r["item_ids"] == [] for r in find_items(docs, benchmark.limit(0)).collect())


def test_an_opening_that_many_items_share():
    """Items with the same beginning, and texts that repeat it, alone or with the rest of an item."""
    import time

    draw = random_words(100_000, 99)
    opening = draw[:18]
    items = [np.concatenate([opening, draw[100 + 22 * k : 122 + 22 * k]]) for k in range(800)]
    index = ItemIndex(list(range(800)), items).build()
    alone = np.tile(opening, 200)
    held = np.concatenate([alone, items[17], draw[50_000:50_040], np.delete(items[400], [20, 31]), alone])
    texts = [alone, held, draw[60_000:61_000]]
    begin = time.time()
    found = index.search(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert time.time() - begin < 2
    assert dict(found) == {1: {17, 400}}
    # questions that differ in few words: all that are near count, however many
    template = draw[70_000:70_040]
    near = []
    for k in range(60):
        near.append(template.copy())
        near[-1][[3, 22]] = draw[80_000 + 2 * k : 80_002 + 2 * k]
    index = ItemIndex(list(range(60)), near).build()
    text = np.concatenate([draw[:30], near[5], draw[30:60]])
    expected = {k for k, item in enumerate(near) if least_edits(item, text) <= max_edits(len(item))}
    assert index.search(text, np.array([0, len(text)]))[0] == expected and len(expected) == 60
