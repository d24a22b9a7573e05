from __future__ import annotations

import hashlib
import random
import re

import pytest

from tallybird.llm import mixing
from tallybird.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, size string, taken string, skey int"


def brute(rows):
    """[(doc_id, size, source_size, target, taken)] by sharing again until no target is too large."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size(t) for _, t, own in rows if own == s) for s in sources}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    out = []
    for s in sources:
        own = [(hashlib.md5((str(i) if i is not None else t or "").encode()).hexdigest(), size(t), i) for i, t, o in rows if o == s]
        epochs = int(target[s] // total[s]) if total[s] else 0
        room = int(target[s] - epochs * total[s])
        for _, n, i in sorted(own, key=lambda x: x[:2]):
            out.append((i, n, total[s], round(target[s], 6), epochs * n + min(n, room)))
            room -= min(n, room)
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, s, "a", "b", 1) for i, t, s in rows], SCHEMA)
    found = mix_sources(docs, keep=docs.columns)
    got = [(r["row"]["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute(rows)


def rows_of(n, sources, seed):
    draw = random.Random(seed)
    return [(k, " ".join("w" * draw.randrange(1, 4) for _ in range(draw.randrange(40))), draw.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b"], ["b", None, "a", "Z", "é", ""], ["big"] * 20 + ["small", "tiny"]])
def test_against_repeated_sharing(spark, sources):
    check(spark, rows_of(150, sources, len(sources)))


def test_odd_rows(spark):
    rows = rows_of(20, ["a", "b"], 9)
    rows += [(None, "a b c", "a"), (None, None, "a"), (3, rows[3][1], rows[3][2]), (50, None, "c"), (51, "", "c"), (52, " \t\n", None),
             (53, "x\x0by\x0cz\x1cw v", "a"), (54, "long " * 30000, "b")]
    check(spark, rows)


def test_empty_and_wordless_tables(spark):
    check(spark, [])
    check(spark, [(1, None, "a"), (2, "", "b")])


def test_many_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    check(spark, rows_of(200, ["hot"] * 5 + ["a", "b"], 11))


def test_no_python_in_the_plan(spark, data_dir):
    plan = mix_sources(spark.read.parquet(f"{data_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
