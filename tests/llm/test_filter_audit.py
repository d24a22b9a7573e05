from __future__ import annotations

import re
from itertools import permutations

from tallybird.llm.filter_audit import audit_filters

DOCS = "doc_id long, text string, source string, n int, id int, part string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Document by document through every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc_id, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = [i for i, t, *_ in rows if (t or "") == text and None not in (i, doc_id) and i < doc_id]
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": bool(smaller),
        }
        docs.append((source or "", failed, doc_id in good, doc_id in bad))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                c = [0] * 6
                for own, failed, is_good, is_bad in docs:
                    if own != part:
                        continue
                    before = any(failed[x] for x in order[: step - 1])
                    here = failed[f] and not before
                    c[0] += not failed[f] and not before
                    c[1] += here
                    c[2] += failed[f] and before
                    c[3] += failed[f] and sum(failed.values()) == 1
                    c[4] += here and is_good
                    c[5] += here and is_bad
                shapley[f] += c[1]
                out[part, order, step] = c
        for (own, order, step), c in out.items():
            if own == part:
                c.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(spark, rows, labels):
    result = audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert result.columns[:3] == ["part", "filter_order", "step"]
    return {tuple(r[:3]): tuple(r[3:]) for r in result.collect()}


def test_against_documents_one_by_one(spark):
    long = " ".join(f"word{k}" for k in range(300))
    texts = [long, long + " #", long.upper(), "a b c", "", None, "same " * 400, long, "x y", "É" * 60 + "A", "A" + "é" * 60]
    texts += ["a\x1cb " * 150, "tab\tand\x0bline\n" * 120, "100%"]
    rows = [(k, t, ["s", "t", None, ""][k % 4], 1, 7, "clash") for k, t in enumerate(texts)]
    rows += [(0, long, "t", 1, 7, "x"), (0, long, "s", 1, 7, "x"), (40, long, "s", 2, 7, "x"), (40, long, "s", 2, 7, "x")]
    rows += [(None, long, "s", 1, 7, "x"), (None, "only nameless", "u", 1, 7, "x"), (None, "only nameless", "u", 1, 7, "x")]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (3, None, 1), (None, 1, 1), (40, 0, 1), (99, 1, 1), (6, 1, 1), (6, 1, 1)]
    got = found(spark, rows, labels)
    assert got == brute(rows, labels)
    assert len(got) == 600 * len({p for p, _, _ in got})


def test_a_very_long_text_and_a_hot_group(spark):
    rows = [(k, "the same text", "hot", 0, 0, "") for k in range(1000)] + [(5000, "w " * 300_000, "b", 0, 0, "")]
    got = found(spark, rows, [])
    assert got["hot", "EABCD", 1] == (1, 999, 0, 0, 0, 0, 999 * 60)
    assert got["hot", "AEBCD", 1][:2] == (0, 1000)
    assert got["b", "BACDE", 1][:2] == (0, 1)


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert len(found(spark, [(1, None, None, 0, 0, "")], [])) == 600


def test_no_python_and_no_cross_join(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    plan = audit_filters(docs, spark.read.parquet(f"{data_dir}/labels.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
