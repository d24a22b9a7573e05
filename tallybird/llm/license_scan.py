"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

DataFrame functions only. Words are runs of letters and digits, lowered; a shingle is ``N`` words (all
words of a shorter template). A document holds a template if some window holds at least
``CONTAINMENT`` of the template's shingles.

Templates fall into classes of up to 8, 16, 32, .. shingles. A class of ``m`` has windows of ``2 * m``
shingles at every ``m``-th shingle, so a passage of the template's length lies whole in one of them.
Bands have one minimum each; their number follows from the least similarity a window can have with a
template it holds, so that it is retrieved with chance ``RECALL`` or more. Of a template of up to ``EXACT``
shingles none may be missing: its windows have just its length, at every shingle, and hold it if they have
the same shingles, so one band always retrieves it.

Before that, a filter that loses nothing: a word in more shingles than may be missing is in every text
that holds the template, and so is one of any words that together are in more shingles than that. Texts
without a word of a small set that meets every template are not cut into shingles, and only texts with the
words of some template of a class into its windows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.llm.staging import staged
from tallybird.llm.texts import whole_text

N = 5
CONTAINMENT = 0.8
RECALL = 0.995
EXACT = 4  # shingles of templates that have to be there whole
TEMPLATE_CHARS = 4 << 20  # of all templates together; beyond, they are joined by shuffles and nothing is filtered
_SEPARATORS = r"[^\p{L}\p{N}]+"

# Public license notices, passages of license texts and usual short wordings. Wordings that
# differ in a version only are short, so that containment tells them apart.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "MIT-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "Apache-2.0-header",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "BSD-redistribution",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "GPL-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "MIT-warranty",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE.",
    ),
    (
        "ISC-permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-conditions",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause-endorsement",
        "may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-warranty",
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "Apache-2.0-compliance",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0-body",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, "
        "publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or "
        "Object form.",
    ),
    (
        "GPL-warranty",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "GPL-preamble",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
        "allowed.",
    ),
    (
        "GPL-2.0-notice",
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "BSL-1.0-permission",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
    ),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    *[
        (f"{name}-short", wording)
        for name, title in (("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD", "BSD License"), ("Apache", "Apache License"))
        for wording in (f"under the {title}", f"under the terms of the {title}", f"under a {title}", f"under {title}")
    ],
    *[
        (f"{name}-short", wording)
        for name, title, number in (
            ("GPL-2.0", "GNU General Public License", "2"),
            ("GPL-3.0", "GNU General Public License", "3"),
            ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
            ("LGPL-3.0", "GNU Lesser General Public License", "3"),
            ("AGPL-3.0", "GNU Affero General Public License", "3"),
            ("MPL-2.0", "Mozilla Public License", "2.0"),
            ("Apache-2.0", "Apache License", "2.0"),
            ("EPL-2.0", "Eclipse Public License", "2.0"),
        )
        for wording in (f"{title} version {number}", f"{title} v{number}", f"{title} {number}")
    ],
    *[
        (f"CC-{kind}-{number}-short", wording)
        for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
        for number in ("3.0", "4.0")
        for wording in (f"under CC {kind} {number}", f"under a CC {kind} {number}", f"under the CC {kind} {number}")
    ],
    *[
        (f"CC-{kind}-4.0-short", f"Creative Commons {name} 4.0")
        for kind, name in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ],
    *[
        (f"{name}-SPDX", f"SPDX-License-Identifier: {name}")
        for name in (
            "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
            "AGPL-3.0", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0",
        )
    ],
)


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("template_id"), F.lit(text).alias("text")) for name, text in TEMPLATES])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SEPARATORS), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` words; empty for fewer words."""
    count = F.size(words) - n
    return F.when(
        count >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def minima(window: Column, bands: int) -> Column:
    """One minimum per band, each under its own hash."""

    def least(band: Column) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, band)))

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), least)


def bands_for(class_size: int, containment: float = CONTAINMENT, recall: float = RECALL) -> int:
    """Bands of one minimum that find the hardest template of a class (over half its size) with
    chance ``recall``."""
    hardest = 0.0
    for size in range(class_size // 2 + 1, class_size + 1):
        held = math.ceil(containment * size - 1e-9)
        similarity = held / (2 * class_size + size - held)
        hardest = max(hardest, math.log(1 - recall) / math.log(1 - similarity) if similarity < 1 else 1.0)
    return math.ceil(hardest)


def class_of(shingles: int) -> int:
    return shingles if shingles <= EXACT else 1 << (shingles - 1).bit_length()


def shingle_sets(text: str, containment: float = CONTAINMENT, n: int = N) -> tuple[set[tuple[str, ...]], int]:
    """The template's shingles, and how many may be missing."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    own = min(n, len(words))
    shingles = {tuple(words[k : k + own]) for k in range(len(words) - own + 1)} if words else set()
    return shingles, len(shingles) - math.ceil(containment * len(shingles) - 1e-9) if len(shingles) > EXACT else 0


def required_words(text: str, containment: float = CONTAINMENT, n: int = N) -> list[str]:
    """Words that every text holding the template has, long ones first: they are in more of its
    shingles than may be missing."""
    shingles, spare = shingle_sets(text, containment, n)
    found = [w for w in {w for s in shingles for w in s} if sum(w in s for s in shingles) > spare]
    return sorted(found, key=lambda w: (-len(w), w))


def rare_words(text: str, containment: float = CONTAINMENT, n: int = N) -> list[str]:
    """Words, long ones first, of which every text holding the template has one: together they are in
    more of its shingles than may be missing."""
    shingles, spare = shingle_sets(text, containment, n)
    chosen: list[str] = []
    for w in sorted({w for s in shingles for w in s}, key=lambda w: (-len(w), w)):
        if sum(not s.isdisjoint(chosen) for s in map(set, shingles)) > spare:
            break
        chosen.append(w)
    return chosen


def needs_of(text: str, containment: float = CONTAINMENT) -> list[list[str]]:
    """Sets of words, one of which is whole in every text that holds the template."""
    required = required_words(text, containment)
    return [[w, *[r for r in required if r != w]] for w in rare_words(text, containment)]


def gate_of(needs: list[list[list[str]]]) -> list[str]:
    """Few words, so that a text which meets some set of any template's ``needs`` has one of them."""
    gate, left = [], [own for sets in needs for own in sets]
    while left:
        each: dict[str, int] = {}
        for own in left:
            for w in own:
                each[w] = each.get(w, 0) + 1
        gate.append(max(each, key=lambda w: (each[w] * (len(w) > 5), len(w), w)))
        left = [own for own in left if gate[-1] not in own]
    return gate


def meets(lowered: Column, sets: list[list[str]]) -> Column:
    """Whether the text has all words of some set."""
    wanted = F.array(*[F.array(*[F.lit(w) for w in own]) for own in sets])

    def whole(text: Column) -> Column:
        return F.exists(wanted, lambda own: F.forall(own, lambda w: F.contains(text, w)))

    return F.exists(F.array(lowered), whole)


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame | None = None,
    text: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(row, licenses): every row of ``docs`` without its text as a struct, and the templates it
    holds as an array of (template_id, containment), by id, with the best window's containment.

    ``templates`` has (template_id, text); templates without words match nothing, and repeated ids
    are reported once. A null or empty text holds nothing; repeated rows are found alike; columns of
    any name pass through in ``row``. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    words = words_of(F.col("text"))
    known = staged(
        templates.where("text IS NOT NULL")
        .withColumn("words", words)
        .withColumn("n", F.least(F.size("words"), F.lit(N)))
        .where("n > 0")
        .withColumn("number", F.xxhash64("template_id", "text")),
        "templates",
    )
    size_of = F.size("words") - F.col("n") + 1
    small = (known.agg(F.sum(F.length("text"))).first()[0] or 0) <= TEMPLATE_CHARS
    classes: dict[tuple[int, int], list[list[str]]] = {}
    if small:
        for r in known.select("n", size_of.alias("size"), "text").distinct().collect():
            classes.setdefault((r["n"], class_of(r["size"])), []).extend(needs_of(r["text"], containment))
    else:
        whole = F.when(size_of <= EXACT, size_of).otherwise(F.pow(F.lit(2), F.ceil(F.log2(size_of))).cast("int"))
        classes = {(r["n"], r["size"]): [] for r in known.select("n", whole.alias("size")).distinct().collect()}
    lengths = sorted({n for n, _ in classes})

    lowered = F.lower(whole_text(docs, text))
    anchored = F.lit(not small)
    for word in gate_of(list(classes.values())):
        anchored = anchored | F.contains(lowered, F.lit(word))
    meeting = {key: F.when(anchored, meets(lowered, sets) if small else F.lit(True)).otherwise(False) for key, sets in classes.items()}
    row = F.struct(*[docs[c] for c in docs.columns if c != text])
    flags = [flag.alias(f"c{n}_{size}") for (n, size), flag in meeting.items()]
    cut = docs.select(row.alias("row"), F.when(anchored, words_of(whole_text(docs, text))).alias("words"), *flags)

    def met(n: int) -> Column:
        return F.array_contains(F.array(*[F.col(f"c{k}_{size}") for k, size in classes if k == n]), True)

    cut = staged(
        cut.select(
            F.monotonically_increasing_id().alias("uid"),
            "row",
            *[F.col(f"c{n}_{size}") for n, size in classes],
            *[F.when(met(n), shingles_of(F.col("words"), n)).alias(f"s{n}") for n in lengths],
        ),
        "shingles",
    )

    found = None
    for n, size in classes:
        exact = size <= EXACT
        bands, step, length = (1, 1, size) if exact else (bands_for(size, containment), size, 2 * size)
        own = (
            known.where(F.col("n") == n)
            .select("template_id", "number", shingles_of(F.col("words"), n).alias("wanted"))
            .where((F.size("wanted") <= size) & (F.size("wanted") > (size - 1 if exact else size // 2)))
        )
        keys = own.select("template_id", "wanted", F.posexplode(minima(F.col("wanted"), bands)).alias("band", "key"))
        shingles = F.col(f"s{n}")
        # a window of the exact length may not reach past the end
        last = F.size(shingles) - (length if exact else 1)
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
        windows = (
            cut.where(F.col(f"c{n}_{size}") & (F.size(shingles) > 0))
            .select("uid", shingles.alias("all"), F.explode(starts).alias("start"))
            .select("uid", F.slice("all", F.col("start") + 1, length).alias("window"))
            .select("uid", "window", F.posexplode(minima(F.col("window"), bands)).alias("band", "key"))
        )
        wanted = F.array_distinct("wanted")
        held = F.size(F.array_intersect(wanted, "window")) / F.size(wanted)
        enough = held >= containment - 1e-9
        if exact:
            enough = (held == 1) & (F.size(F.array_except("window", wanted)) == 0)
        hits = windows.join(F.broadcast(keys) if small else keys, ["band", "key"])  # small: up to TEMPLATE_CHARS
        hits = hits.select("uid", "template_id", held.alias("held"), enough.alias("enough")).where("enough").drop("enough")
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        nothing = F.array().cast("array<struct<template_id:string,containment:double>>")
        return cut.select("row", nothing.alias("licenses"))
    by_row = (
        found.groupBy("uid", "template_id")
        .agg(F.max("held").alias("containment"))
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("template_id", "containment"))).alias("licenses"))
    )
    return cut.select("uid", "row").join(by_row, "uid", "left").select(
        "row", F.coalesce("licenses", F.array().cast(by_row.schema["licenses"].dataType)).alias("licenses")
    )
