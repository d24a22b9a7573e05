from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybird.llm.tokens import LETTERS, LOWER, PIECES, grams, text_slices, tokenise

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n\x0b\x1c.!7_", max_size=30)), max_size=6)


def tokens_of(texts, classes=None, table=None, limit=1 << 20):
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string()), limit):
        args = [] if classes is None else [classes]
        if table is not None:
            args.append(table)
        t = tokenise(data, offsets, *args)
        raw = data.tobytes()
        for a, b in zip(t.bounds, t.bounds[1:]):
            out.append([(raw[s:e].decode(), int(h)) for s, e, h in zip(t.start[a:b], t.end[a:b], t.hashes[a:b])])
    return out


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([1, 8, 1 << 20]))
def test_words_are_runs_without_white_space(texts, limit):
    found = tokens_of(texts, limit=limit)
    wanted = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [[w for w, _ in own] for own in found] == wanted
    hashes = {}
    for own in found:
        for word, value in own:
            assert hashes.setdefault(word, value) == value
    assert len(set(hashes.values())) == len(hashes)


def test_classes_and_case():
    pieces = tokens_of(["The end!!! of x_1, été"], PIECES)[0]
    assert [w for w, _ in pieces] == ["The", "end", "!!!", "of", "x_1", ",", "été"]
    letters = tokens_of(["The END... the end"], LETTERS, LOWER)[0]
    assert [w for w, _ in letters] == ["The", "END", "the", "end"]
    assert letters[0][1] == letters[2][1] and letters[1][1] == letters[3][1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=9), max_size=5), st.integers(1, 5))
def test_grams(texts, n):
    tokens = np.array([x for t in texts for x in t], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found, ends = grams(tokens, bounds, n)
    names = {}
    for k, t in enumerate(texts):
        wanted = [tuple(t[i : i + n]) for i in range(len(t) - n + 1)] or ([tuple(t)] if t else [])
        own = found[ends[k] : ends[k + 1]].tolist()
        assert len(own) == len(wanted)
        for gram, value in zip(wanted, own):
            assert names.setdefault(gram, value) == value
    assert len(set(names.values())) == len(names)
