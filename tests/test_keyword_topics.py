from __future__ import annotations

import random

from tallybird.operators import keyword_topics as module
from tallybird.operators.keyword_topics import keyword_topics
from tallybird.operators.sentiment import TOPICS, topic_array

KEYWORDS = "topic string, keyword string, place int"


def brute(texts, keywords):
    place = {}
    for topic, word, at in keywords:
        if topic is not None and word:
            place[topic] = min(place.get(topic, at), at)
    order = sorted(place, key=lambda t: (place[t], t))
    out = []
    for text in texts:
        held = {t for t, w, _ in keywords if t is not None and w and w.lower() in (text or "").lower()}
        out.append([t for t in order if t in held] or ["General"])
    return out


def test_50_000_keywords_in_blocks(spark, monkeypatch):
    draw = random.Random(1)
    word = lambda low, high: "".join(draw.choice("abcde") for _ in range(draw.randrange(low, high)))
    keywords = [(f"t{draw.randrange(40)}", word(5, 10), draw.randrange(30)) for _ in range(50_000)]
    keywords += [("t1", "ÉCOLE", 3), (None, "a", 1), ("t2", "", 0), ("t3", None, 0), ("zz", "shared", 50), ("aa", "shared", 50)]
    texts = [" ".join(word(1, 12) for _ in range(30)) for _ in range(40)]
    texts += [None, "", "xyz", "the école", "un SHARED word"]
    docs = spark.createDataFrame([(k, t, "clash", "x") for k, t in enumerate(texts)], "id int, text string, topics string, lowered_text string")
    table = spark.createDataFrame(keywords, KEYWORDS)
    expected = brute(texts, keywords)
    for size in (1_000_000, 20_000):
        monkeypatch.setattr(module, "BLOCK", size)
        found = keyword_topics(docs, table)
        assert found.columns == ["id", "text", "lowered_text", "topics"]
        assert [r["topics"] for r in sorted(found.collect())] == expected


def test_the_fixed_topics(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    table = spark.createDataFrame([(t, w, k) for k, (t, words) in enumerate(TOPICS.items()) for w in words], KEYWORDS)
    ours = sorted(map(tuple, keyword_topics(docs, table).select("doc_id", "topics").collect()))
    assert ours == sorted(map(tuple, docs.select("doc_id", topic_array(docs["text"]).alias("topics")).collect()))


def test_a_long_text_and_empty_tables(spark):
    docs = spark.createDataFrame([("word " * 400_000 + "needle",), ("word",)], "text string")
    table = spark.createDataFrame([("N", "needle", 1), ("W", "word", 0)], KEYWORDS)
    assert sorted(r["topics"] for r in keyword_topics(docs, table).collect()) == [["W"], ["W", "N"]]
    assert [r["topics"] for r in keyword_topics(docs.limit(1), table.limit(0)).collect()] == [["General"]]
    assert keyword_topics(docs.limit(0), table).collect() == []
