from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybird.llm import conversation_trie
from tallybird.llm.conversation_trie import Parentheses, prefix_trie, rebuilt, turn_order
from tallybird.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, shard int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def depths(shape: list[int]) -> np.ndarray:
    """Any numbers as depths in preorder."""
    out = [0]
    for x in shape:
        out.append(1 + x % (out[-1] + 1))
    return np.array(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 300))
def test_parentheses(shape, deep):
    depth = depths(shape)
    depth = np.concatenate([np.arange(deep), depth + deep])  # long chains leave their block
    trie, stack, close = Parentheses(depth), [], {}
    bits = [1 if k else -1 for k in np.isin(np.arange(2 * len(depth)), trie.open)]
    for place, bit in enumerate(bits):
        if bit > 0:
            stack.append(place)
        else:
            close[stack.pop()] = place
    assert not stack
    found = trie.findclose(trie.open)
    assert found.tolist() == [close[p] for p in trie.open.tolist()]
    assert trie.rank(found).tolist() == [sum(b > 0 for b in bits[:p]) for p in found.tolist()]
    assert trie.leaf.tolist() == [close[p] == p + 1 for p in trie.open.tolist()]


def test_a_wide_and_a_very_deep_trie():
    depth = np.concatenate([np.arange(100_000), np.full(50_000, 7)])
    trie = Parentheses(depth)
    close = trie.findclose(trie.open)
    assert close[0] == 2 * len(depth) - 1 and trie.rank(close[:1])[0] == len(depth)
    assert trie.rank(close[7:8])[0] == 100_000


def own_turns(rows):
    """Conversations as lists of (role, text)."""
    convs = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv_id, []).append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t for _, _, t in sorted(turns)] for c, turns in convs.items()}


def rebuilt_turns(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        host = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(host, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    below = {p: [0, 0] for p in members}
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += (len(members[p]) - 1) * words
    out = []
    for p, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), len(children.get(p, [])), *below[p], digest))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n, first=-30):
    draw, rows = random.Random(seed), []
    for c in range(first, first + n):
        for turn in range(draw.choice([1, 2, 3, 4, 6])):
            rows.append((c, turn, draw.choice(["user", "bot"]), draw.choice(["a", "a b", "c  d\te", ""]), 1, 1))
    draw.shuffle(rows)
    return rows


ODD = [
    (7, None, "user", "no turn", 0, 0), (7, 3, None, None, 0, 0), (7, 3, "user", "same turn", 0, 0), (7, 3, "user", "same turn", 0, 0),
    (None, 1, "user", "no conversation", 0, 0), (20, 0, "u", "x y z", 0, 0), (21, 0, "u", "x y z", 0, 0), (10**15, 0, "u", "far", 0, 0),
    (40, 5, "u", "only one", 0, 0),
]


@pytest.mark.parametrize("shard_turns,partitions", [(1 << 20, 1), (1 << 20, 40), (5, 3), (1, 40)])
def test_against_brute_force(spark, monkeypatch, shard_turns, partitions):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(conversation_trie, "FAN", 3)
    monkeypatch.setattr(conversation_trie, "PIECE_IDS", 2)
    rows = made(shard_turns + partitions, 150) + ODD
    rows += [(c, t, "u", "a hot conversation", 0, 0) for c in range(500, 560) for t in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    own = own_turns(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(prefix_trie(rebuilt(turn_order(docs)))) == brute(rebuilt_turns(own))
        if partitions == 40:
            assert found(prefix_trie(turn_order(docs))) == brute(own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_conversation_and_long_texts(spark):
    rows = [(1, t, "u", f"turn {t}", 0, 0) for t in range(5000)] + [(2, t, "u", f"turn {t}", 0, 0) for t in range(4990)]
    rows += [(3, 0, "u", "word " * 300_000, 0, 0), (4, 0, "u", "word " * 300_000, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = found(prefix_trie(turn_order(docs)))
    root = next(r for r in got if r[1] == 0)
    assert root[3:7] == (4, 2, 2, 4990 * 2 + 300_000) and len(got) == 5002
    assert max(r[1] for r in got) == 5000


def test_empty_tables_and_conversations_without_turns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert found(prefix_trie(rebuilt(turn_order(docs)))) == []
    nobody = spark.createDataFrame([(None, 1, "u", "x", 0, 0)], SCHEMA)
    assert found(prefix_trie(turn_order(nobody))) == []
    # conversations of one turn that have a turn of an absent host in front
    lone = [(c, 0, "u", "x", 0, 0) for c in range(101, 112)]
    convs = rebuilt_turns(own_turns(lone))
    assert any(not turns for turns in convs.values())
    assert found(prefix_trie(rebuilt(turn_order(spark.createDataFrame(lone, SCHEMA))))) == brute(convs)


def test_the_query_against_brute_force(spark, data_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").collect()]
    assert found(op12_conversation_trie(spark, data_dir)) == brute(rebuilt_turns(own_turns(rows)))
