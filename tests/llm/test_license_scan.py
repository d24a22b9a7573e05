from __future__ import annotations

import math
import re

import pytest

from tallybird.llm import license_scan
from tallybird.llm.license_scan import EXACT, TEMPLATES, bands_for, gate_of, needs_of, rare_words, scan_licenses

LINES = dict(TEMPLATES)
FILL = "some words that are no license at all go here and there "


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(text, templates, n=5, containment=0.8):
    """Every window of every template's class, one by one."""
    out, read = [], words(text)
    for name, template in templates:
        own = words(template)
        k = min(n, len(own))
        if not own:
            continue
        shingles = [tuple(own[i : i + k]) for i in range(len(own) - k + 1)]
        m, size = len(shingles), 1 << (len(shingles) - 1).bit_length()
        doc = [tuple(read[i : i + k]) for i in range(len(read) - k + 1)]
        if m <= EXACT:  # all of them in a row
            if any(set(doc[s : s + m]) == set(shingles) for s in range(len(doc) - m + 1)):
                out.append(name)
            continue
        held = max((len(set(shingles) & set(doc[s : s + 2 * size])) for s in range(0, len(doc), size)), default=0)
        if held >= containment * len(set(shingles)) - 1e-9:
            out.append(name)
    return sorted(set(out))


def test_against_all_windows(spark):
    texts = [LINES[name] for name in LINES]
    texts += [FILL * 30 + line + FILL * 7 for line in texts]
    texts += [LINES["MIT-permission"].replace("merge", "join"), LINES["MIT-permission"][:200], LINES["GPL-3.0"].upper()]
    texts += [LINES["MIT"] + " " + LINES["CC-BY-NC-4.0"], FILL * 3000 + LINES["GPL-3.0-notice"], None, "", "license", FILL]
    rows = [(k, t, "a", 1) for k, t in enumerate(texts)] + [(None, texts[0], None, None), (1, texts[1], "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, licenses int")
    found = scan_licenses(docs).select("row.*", "licenses").drop("licenses")  # names clash, rows stay whole
    assert found.columns[:2] == ["doc_id", "uid"]
    found = scan_licenses(docs.select("doc_id", "text")).collect()
    got = sorted(((r["row"]["doc_id"], [x["template_id"] for x in r["licenses"]]) for r in found), key=repr)
    assert got == sorted(((i, brute(t, TEMPLATES)) for i, t, _, _ in rows), key=repr)


def test_own_templates_short_repeated_and_empty(spark):
    templates = [("one", "copyleft"), ("two", "share alike"), ("two", "share alike"), ("none", " . "), ("null", None)]
    own = spark.createDataFrame(templates, "template_id string, text string")
    docs = spark.createDataFrame([(1, "all copyleft"), (2, "Share, alike!"), (3, "share and alike")], "doc_id long, text string")
    found = {r["row"]["doc_id"]: [x["template_id"] for x in r["licenses"]] for r in scan_licenses(docs, own).collect()}
    assert found == {1: ["one"], 2: ["two"], 3: []}
    assert scan_licenses(docs.limit(0)).collect() == []
    empty = own.limit(0)
    assert [r["licenses"] for r in scan_licenses(docs, empty).collect()] == [[], [], []]


def test_no_python_in_the_plan(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    plan = scan_licenses(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rare_words_are_in_more_shingles_than_may_be_missing():
    for _, text in TEMPLATES:
        own, chosen = words(text), set(rare_words(text))
        n = min(5, len(own))
        shingles = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        spare = len(shingles) - math.ceil(0.8 * len(shingles) - 1e-9)
        assert sum(not chosen.isdisjoint(s) for s in shingles) > spare
    assert not set(rare_words(LINES["MIT-warranty"])) & {"the", "in", "of", "or", "software", "license"}


def test_texts_full_of_common_license_words(spark):
    common = "the software is in the license of any kind or use without conditions and liability "
    texts = [common * 40 + LINES["MIT-warranty"], common * 40, common + "merchantability noninfringement connection " + common * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["row"]["doc_id"]: [x["template_id"] for x in r["licenses"]] for r in scan_licenses(docs).collect()}
    assert found == {k: brute(t, TEMPLATES) for k, t in enumerate(texts)} and "MIT-warranty" in found[0]


def test_templates_beyond_the_size_for_a_filter(spark, monkeypatch):
    texts = [FILL + LINES[name] + FILL for name in list(LINES)[:12]] + [FILL, "a b c a b c a b c", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = [*list(TEMPLATES)[:12], ("twice", "a b c a b c"), ("again", "x x x x x x x"), ("again", "a b c a b")]
    own = spark.createDataFrame(few, "template_id string, text string")
    expected = {k: brute(t, few) for k, t in enumerate(texts)}
    for limit in (license_scan.TEMPLATE_CHARS, 10):
        monkeypatch.setattr(license_scan, "TEMPLATE_CHARS", limit)
        found = {r["row"]["doc_id"]: [x["template_id"] for x in r["licenses"]] for r in scan_licenses(docs, own).collect()}
        assert found == expected


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_bands_guarantee_the_recall(size):
    for t in range(size // 2 + 1, size + 1):
        held = math.ceil(0.8 * t - 1e-9)
        similarity = held / (2 * size + t - held)
        assert 1 - (1 - similarity) ** bands_for(size) >= 0.995 - 1e-9


def test_other_licenses_and_wordings(spark):
    texts = {
        "Licensed under the MIT License": "MIT-short",
        "See the GNU Lesser General Public License v2.1 for more": "LGPL-2.1-short",
        "covered by the GNU Affero General Public License, version 3": "AGPL-3.0-short",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0-header",
        LINES["BSD-conditions"]: "BSD-conditions",
        LINES["Unlicense"]: "Unlicense",
        "shared under a CC BY-SA 4.0 license": "CC-BY-SA-4.0-short",
        "// SPDX-License-Identifier: ISC": "ISC-SPDX",
    }
    docs = spark.createDataFrame([(FILL + t + " " + FILL, name) for t, name in texts.items()], "text string, name string")
    for row in scan_licenses(docs).collect():
        assert row["row"]["name"] in [x["template_id"] for x in row["licenses"]]


def test_the_filter_loses_nothing():
    gate = gate_of([needs_of(text) for _, text in TEMPLATES])
    for _, text in TEMPLATES:
        own = words(text)
        n = min(5, len(own))
        shingles = [set(own[k : k + n]) for k in range(len(own) - n + 1)]
        for own_set in needs_of(text):
            assert set(gate) & set(own_set)
        spare = int(0.2 * len(shingles) + 1e-9)
        for first in range(len(shingles)):  # any run of shingles is missing
            left = set().union(*shingles[:first], *shingles[first + spare :])
            assert any(set(own_set) <= left for own_set in needs_of(text))
