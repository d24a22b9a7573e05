from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallybird.functions.dates import calendar
from tallybird.functions.polarity import IDIOMS, LEXICON, polarity, polarity_by_table
from tallybird.functions.stats import (
    exact_quantiles,
    median,
    running_total,
    safe_corr,
    small_domain_quantiles,
)
from tallybird.functions.text import strip_whitespace, title_case

PROBS = [0.0, 0.2, 0.25, 0.5, 0.6, 0.8, 1.0]


@pytest.mark.parametrize(
    "values",
    [
        [7.0],
        [1.0, 2.0],
        [5.0] * 40,
        [0.0] * 500 + list(range(100)),
        list(np.round(np.random.default_rng(3).lognormal(3, 2, 3000), 2)),
        list(range(1000, 0, -1)),
    ],
    ids=["one", "two", "constant", "hot value", "skewed", "descending"],
)
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    expected = np.quantile(values, PROBS)
    assert np.allclose(exact_quantiles(df, "x", PROBS).first()["q"], expected)
    assert np.allclose(small_domain_quantiles(df, "x", PROBS).first()["q"], expected)


def test_quantiles_skip_nulls_and_survive_emptiness(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).first()["q"] == [2.0]
    assert exact_quantiles(df.where("x > 9"), "x", [0.5]).first()["q"] == [None]
    filled = df.select(F.coalesce("x", median(df, "x")).alias("x"))
    assert rows(filled) == [(1.0,), (2.0,), (3.0,)]


def test_running_total_is_a_plain_cumulative_sum(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "v": rng.permutation(2000)})
    pdf["w"] = rng.integers(1, 9, 2000)
    got = running_total(spark.createDataFrame(pdf), "v", "w", by=["g"]).toPandas()
    pdf = pdf.sort_values("v")
    pdf["_upto"] = pdf.groupby("g")["w"].cumsum()
    pdf["_total"] = pdf.groupby("g")["w"].transform("sum")
    merged = got.merge(pdf, on=["g", "v", "w"], suffixes=("", "_want"))
    assert len(merged) == 2000
    assert (merged["_upto"] == merged["_upto_want"]).all()
    assert (merged["_total"] == merged["_total_want"]).all()


def test_safe_corr(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, 7.0, 5.0), (None, 9.0, 5.0)],
        "a double, b double, c double",
    )
    a, b, c = (F.col(x) for x in "abc")
    got = df.agg(safe_corr(a, b).alias("ab"), safe_corr(a, c).alias("ac")).first()
    assert got["ab"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 7])[0, 1])
    assert got["ac"] is None
    assert df.limit(1).agg(safe_corr(a, b).alias("r")).first()["r"] is None


def test_title_case_equals_pandas(spark):
    texts = ["o'brien st-john", "2nd street", "ÉCOLE normale", "UPI", "net  banking", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["t"] for r in df.orderBy("i").select(title_case(F.col("t")).alias("t")).collect()]
    assert got == list(pd.Series(texts).str.title())


def test_strip_removes_every_kind_of_whitespace(spark):
    df = spark.createDataFrame([("\t a b\n",), (" x ",)], "t string")
    assert rows(df.select(strip_whitespace(F.col("t")))) == [("a b",), ("x",)]


def test_plain_texts_take_the_short_way_to_the_same_result(spark):
    texts = ["net BANKING", "  cOD ", " a  b ", "a\n", "\na b", "ab\u2028", "\u00a0x y", "İI", "", "   ", None, "x1 y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tidy = title_case(strip_whitespace(F.col("t")))
    got = [r["t"] for r in df.orderBy("i").select(tidy.alias("t")).collect()]
    stripped = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    runs = F.regexp_extract_all(stripped, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    want = df.orderBy("i").select(F.array_join(F.transform(runs, F.initcap), "").alias("t")).collect()
    assert got == [r["t"] for r in want]
    text = df.select(tidy)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in text


def test_calendar_per_group(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', DATE '2024-02-27'), ('a', DATE '2024-03-01'),"
        " ('b', DATE '2024-01-01') t(g, d)"
    )
    got = calendar(df, "d", by=["g"]).toPandas().groupby("g").size().to_dict()
    assert got == {"a": 4, "b": 1}
    assert calendar(df.where("false"), "d").count() == 0


def _expected(total, marks=0.0):
    total += np.sign(total) * marks
    return round(total / (total * total + 15) ** 0.5, 4)


GOOD, BAD, GREAT = LEXICON["good"], LEXICON["bad"], LEXICON["great"]


@pytest.mark.parametrize(
    "text, score",
    [
        ("good", _expected(GOOD)),
        ("not good", _expected(GOOD * -0.74)),
        ("good!!", _expected(GOOD, 2 * 0.292)),
        ("good!!!!!!!", _expected(GOOD, 4 * 0.292)),
        ("bad??", _expected(BAD, 2 * 0.18)),
        ("bad?????", _expected(BAD, 0.96)),
        ("very good", _expected(GOOD + 0.293)),
        ("very bad", _expected(BAD - 0.293)),
        ("slightly good", _expected(GOOD - 0.293)),
        ("very much good", _expected(GOOD + 0.293 * 0.95)),
        ("not very good", _expected((GOOD + 0.293) * -0.74)),
        ("it was GOOD", _expected(GOOD + 0.733)),
        ("GOOD", _expected(GOOD)),
        ("bad but great", _expected(BAD * 0.5 + GREAT * 1.5)),
        ("wasn't good", _expected(GOOD * -0.74)),
        ("\"good\", (bad)", _expected(GOOD + BAD)),
        ("they are never so good", _expected((GOOD + 0.293) * 1.5 * 1.25)),
        ("never this good", _expected(GOOD * 1.5)),
        ("never so very good", _expected(((GOOD + 0.293) + 0.293 * 0.95) * 1.25)),
        ("the least good", _expected(GOOD * -0.74)),
        ("least good", _expected(GOOD * -0.74)),
        ("at least good", _expected(GOOD)),
        ("very least good", _expected(GOOD + 0.293 * 0.95)),
        ("it is only kind of good", _expected(GOOD - 0.293)),
        ("it was just enough good", _expected(GOOD - 0.293)),
        ("we say yeah right good", _expected(IDIOMS["yeah right"])),
        ("it really is such a bad ass car", _expected(IDIOMS["bad ass"])),
        ("good :)", _expected(GOOD + LEXICON[":)"])),
        ("chair <3 :'(", _expected(LEXICON["<3"] + LEXICON[":'("])),
        ("good:)", _expected(GOOD)),
        ("table chair", 0.0),
        ("", 0.0),
    ],
)
def test_polarity_rules(spark, text, score):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(polarity("t").alias("s")).first()["s"] == pytest.approx(score, abs=1e-9)


TEXTS = [
    "The kind of good one, but NOT the best!!", "never so good; at least bad :( ?? ??", "it is a KISS of death great", "",
    "They say least helpful -- sort of AWFUL but fine", "good " * 3000, None, "no words here", ":D :d GOOD", "kind of kind good",
]


def test_polarity_by_table_equals_the_expression(spark, data_dir):
    lexicon = spark.createDataFrame([*LEXICON.items(), ("good", 9.0), (None, 1.0), ("x", None)], "token string, valence double")
    texts = [(k, t, "clash") for k, t in enumerate(TEXTS * 3)] + [(100 + k, "it was very good, never bad", "hot") for k in range(300)]
    df = spark.createDataFrame(texts, "id int, text string, text_digest string")
    documents = spark.read.parquet(f"{data_dir}/documents.parquet").select(F.col("doc_id").cast("int").alias("id"), "text")
    for docs in (df, documents, df.limit(0)):
        by_table = polarity_by_table(docs, lexicon)
        assert by_table.columns == [*docs.columns, "sentiment_score"]
        assert rows(by_table) == rows(docs.withColumn("sentiment_score", polarity("text")))
    plan = polarity_by_table(df, lexicon)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "Python" not in plan


def test_a_lexicon_of_200_000_tokens(spark):
    lexicon = spark.range(200_000).selectExpr("concat('token', id) AS token", "id % 9 - 4.0D AS valence")
    df = spark.createDataFrame([("token7 chair, token8!",), ("Token199999 but token13 token1x",)], "text string")
    got = [r["sentiment_score"] for r in polarity_by_table(df, lexicon).collect()]
    whole = [7 % 9 - 4.0 + 8 % 9 - 4.0, 0.5 * (199999 % 9 - 4) + 1.5 * (13 % 9 - 4)]
    assert sorted(got) == sorted([_expected(whole[0], 0.292), _expected(whole[1])])


def test_polarity_uses_the_whole_text_and_any_lexicon(spark):
    long = "word " * 30_000 + "splendid"
    df = spark.createDataFrame([(long,), (None,)], "t string")
    got = [r[0] for r in df.select(polarity("t", {"splendid": 2.0, "it's": 1.0})).collect()]
    assert got == [_expected(2.0), None]
    assert [r[0] for r in df.select(polarity("t", {})).collect()] == [0.0, None]


def test_tokens_meet_the_lexicon_where_they_lie(spark):
    """Copies of a text in many partitions, scored as by the plan's own lexicon; only hits are gathered by text."""
    texts = F.array(*[F.lit(t) for t in ("Not a good box, but GREAT value!", "nothing at all", "", "bad bad luck :(")])
    docs = spark.range(0, 400, 1, 7).select("id", F.get(texts, (F.col("id") % 5).cast("int")).alias("text"))
    entries = F.array(*[F.struct(F.lit(k).alias("token"), F.lit(v).alias("valence")) for k, v in LEXICON.items()])
    scored = polarity_by_table(docs, spark.range(1).select(F.inline(entries)))
    found = {tuple(r) for r in scored.select("id", "sentiment_score").collect()}
    assert found == {tuple(r) for r in docs.select("id", polarity("text")).collect()} and len(found) == 400
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(text_digest#\d+, token", plan)
