from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybird.llm import token_planes
from tallybird.llm.queries import op11_token_ids
from tallybird.llm.token_planes import Encoder, Reader, Writer, from_planes, id_files, read_ids, takes_words, to_planes, write_ids

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(WORD_FILE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=300), st.sampled_from([4, 32]))
def test_planes_round_trip(ids, planes):
    ids = np.array(ids, np.uint32)
    parts = to_planes(ids, planes)
    assert len(parts) == planes
    assert from_planes(parts, len(ids)).tolist() == ids.tolist()


@pytest.mark.parametrize("planes", [4, 32])
def test_a_file(tmp_path, planes):
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 40, 500)
    ids = rng.integers(0, 60_000, counts.sum()).astype(np.uint32)
    keys = pa.array([None if k % 97 == 0 else k - 250 for k in range(500)], pa.int64())
    out, ends = Writer(str(tmp_path / "x"), planes, block=256), np.concatenate([[0], np.cumsum(counts)])
    for low, high in ((0, 3), (3, 3), (3, 400), (400, 500)):
        out.add(keys.slice(low, high - low), counts[low:high], ids[ends[low] : ends[high]])
    assert not os.path.exists(tmp_path / "x")
    assert out.close() == (500, len(ids), os.path.getsize(tmp_path / "x"))
    assert os.listdir(tmp_path) == ["x"]
    file = Reader(str(tmp_path / "x"))
    assert file.counts.tolist() == counts.tolist()
    assert [None if n else k for k, n in zip(file.keys.tolist(), file.nulls)] == keys.to_pylist()
    assert len(file.index) == -(-len(ids) // 256)
    for first, last in ((0, len(ids)), (0, 1), (255, 257), (1000, 1000), (5000, 5600), (len(ids) - 1, len(ids) + 9)):
        assert file.ids(first, last).tolist() == ids[first:last].tolist()
    (tmp_path / "y").write_bytes(b"no such file" * 20)
    with pytest.raises(ValueError):
        Reader(str(tmp_path / "y"))


def test_which_tokenizers_may_go_word_by_word():
    assert takes_words(WORD_FILE) and not takes_words(BYTE_FILE)


ODD = st.text(st.sampled_from("aAbİΣςéÉ́̈ ẞ0１' \t\x0b\x0c\r\n\x1c\x85  　<|startofxe>.-_\U0001f600中ſ"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD | st.text(max_size=30) | st.sampled_from(["", "<|endoftext|> a<|startoftext|>b", "it's 's  'S"]), max_size=6))
def test_words_give_the_ids_of_the_whole_text(texts):
    ids, counts = Encoder(WORD_FILE, True)(pa.array(texts, pa.string()))
    expected = [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_pieces_are_forgotten_and_encoded_again(monkeypatch):
    monkeypatch.setattr(token_planes, "KNOWN", 2)
    encode, texts = Encoder(WORD_FILE, True), ["One, two don't", "ONE two; three J̌ ǰ", "one4two x<=y", "a|b two one"]
    for text in texts * 2:
        assert encode(pa.array([text]))[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def brute(rows, end=(1,)):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + list(end), "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def digest(spark, folder):
    got = read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    return sorted(map(tuple, got), key=lambda r: (r[1], r[2]))


@pytest.mark.parametrize("planes", [4, 32])
def test_round_trip(spark, tmp_path, planes):
    texts = ["Hello, World", None, "", "one two  three\tfour", "<|endoftext|>", "É" * 50, "word " * 40_000, "x" * 3000]
    rows = [(7 * k % 31 - 9, f"{t or ''} {k}" if k % 3 else t) for k, t in enumerate(texts * 6)]
    rows = list({r[0]: r for r in rows}.values()) + [(None, "no id"), (10**12, "far")]
    docs = spark.createDataFrame([(*r, "start", 5) for r in rows], "doc_id long, text string, start string, n_tokens int")
    folder = write_ids(docs.repartition(3), WORD_FILE, str(tmp_path / "ids"), planes=planes)
    assert digest(spark, folder) == brute(rows)
    files = id_files(spark, folder).collect()
    assert sum(f["n_docs"] for f in files) == len(rows)
    assert sorted(f for f in os.listdir(tmp_path / "ids") if f.startswith(("ids", "."))) == sorted(f["file"] for f in files)


def test_repeated_rows_and_no_end(spark, tmp_path):
    rows = [(4, "same text")] * 500 + [(4, "other"), (2, "before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    folder = write_ids(docs, WORD_FILE, str(tmp_path / "a"), end_id=None)
    got = digest(spark, folder)
    ends = np.cumsum([0] + [r[2] for r in got])
    assert [r[1] for r in got] == ends[:-1].tolist() and got[0][0] == 2
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(rows, end=()))


def test_files_end_at_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_planes, "FILE_IDS", 100)
    rows = [(k, f"text number {k} " * (k % 9)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    folder = write_ids(docs, WORD_FILE, str(tmp_path / "cut"))
    files = id_files(spark, folder).collect()
    assert len(files) > 20 and all(f["n_ids"] < 100 + 60 for f in files)
    assert digest(spark, folder) == brute(rows)


def test_a_file_without_documents(tmp_path):
    assert Writer(str(tmp_path / "w")).close()[:2] == (0, 0)
    empty = Reader(str(tmp_path / "w"))
    assert empty.n_docs == 0 and empty.ids(0, 10).tolist() == []


def test_a_text_longer_than_a_slice(spark, tmp_path):
    pieces = list(token_planes._pieces("ab cd " * 10))
    assert "".join(pieces) == "ab cd " * 10
    text = "Some Words " * (token_planes.SLICE // 10)
    docs = spark.createDataFrame([(1, "first"), (2, text)], "doc_id long, text string")
    folder = write_ids(docs, WORD_FILE, str(tmp_path / "long"))
    words = WHOLE.encode("Some Words", add_special_tokens=False).ids
    got = read_ids(spark, folder).where("doc_id = 2").first()
    expected = np.array(words * (token_planes.SLICE // 10) + [1], "<u4")
    assert got["n_tokens"] == len(expected) and bytes(got["ids"]) == expected.tobytes()


def test_a_tokenizer_that_keeps_space(spark, tmp_path):
    whole = Tokenizer.from_file(BYTE_FILE)
    rows = [(1, "two  words"), (2, " and\nmore ")]
    folder = write_ids(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_FILE, str(tmp_path / "b"), end_id=50256)
    got = {r["doc_id"]: token_planes.unpacked(r["ids"]) for r in read_ids(spark, folder).collect()}
    assert got == {i: whole.encode(t, add_special_tokens=False).ids + [50256] for i, t in rows}


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = write_ids(docs, WORD_FILE, str(tmp_path / "none"))
    assert read_ids(spark, folder).collect() == [] and read_ids(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids"]


def test_the_query_against_brute_force(spark, data_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op11_token_ids(spark, data_dir).collect()), key=lambda r: r[1]) == brute(rows)
