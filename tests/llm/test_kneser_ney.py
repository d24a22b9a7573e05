from __future__ import annotations

import math
import os
import re
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallybird.llm.kneser_ney import Counts, Shelf, Sums, discounts_from, fit_model, keep_shard, mounted, pack, past_numbers, score_texts, unpack
from tallybird.llm import kneser_ney
from tallybird.llm.kneser_ney import pack_keys, unpack_keys
from tallybird.llm.queries import op10_language_model_scores
from tallybird.llm.tokens import text_slices

TRAIN = [
    "the cat sat on the mat", "The cat ate the rat", "the dog sat on the cat", "a rat sat", "the the the", "", None, "dog dog cat\tsat\non",
    "on the mat the dog ate a rat and a cat", "É é x\x1cy", "the cat sat on the mat",
]
TEXTS = [*TRAIN, "the zebra sat on the unknown mat", "zebra", " \n ", "word " * 3000 + "the cat"]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]


class Brute:
    """Dictionaries instead of files."""

    def __init__(self, train, order):
        self.order, lists = order, [tokens(t) for t in train]
        self.counts = Counter(t for own in lists for t in own)
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        grams = Counter()
        for own in lists:
            padded = ["<s>"] * (order - 1) + own
            grams.update(tuple(padded[k : k + order]) for k in range(len(own)))
        self.grams = {order: grams}
        for level in range(order - 1, 0, -1):
            self.grams[level] = Counter(g[1:] for g in self.grams[level + 1])
        self.discount, self.after = {}, {}
        for level, table in self.grams.items():
            self.discount[level] = discounts_from([sum(c == k for c in table.values()) for k in (1, 2, 3, 4)])
            self.after[level] = defaultdict(list)
            for gram, c in table.items():
                self.after[level][gram[:-1]].append(c)

    def chance(self, gram):
        level = len(gram)
        if level == 0:
            return 1 / (self.v + 1)
        below = self.chance(gram[1:])
        after = self.after[level].get(gram[:-1])
        if not after:
            return below
        c, d = self.grams[level].get(gram, 0), self.discount[level]
        spent = sum(d[min(x, 3)] for x in after)
        return max(c - d[min(c, 3)], 0) / sum(after) + spent / sum(after) * below

    def score(self, text):
        own = tokens(text)
        padded = ["<s>"] * (self.order - 1) + own
        return sum(math.log10(self.chance(tuple(padded[k : k + self.order]))) for k in range(len(own)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, order):
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, "the cat", 1), (0, TEXTS[0], 1)], "doc_id long, text string, word int")
    brute = Brute(TRAIN, order)
    rows = score_texts(docs, fit_model(train, order=order)).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        own = tokens(row["text"])
        assert row["n_tokens"] == len(own) and row["n_known"] == sum(t in brute.counts for t in own)
        assert row["train_tokens"] == brute.n
        base = sum(math.log10((brute.counts[t] + 1) / (brute.n + brute.v + 1)) for t in own)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert math.isclose(row["score"], brute.score(row["text"]), rel_tol=1e-9)


def test_brute_force_sums_to_one():
    brute = Brute(TRAIN, 2)
    for history in ("the", "zebra", "<s>"):
        total = sum(brute.chance((history, w)) for w in brute.counts) + brute.chance((history, "never seen"))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    empty = spark.createDataFrame([], "text string")
    model = fit_model(empty)
    row = score_texts(spark.createDataFrame([("a b",)], "text string"), model).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)
    assert score_texts(empty, model).collect() == []


def test_better_than_the_base_on_held_out_text(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    model = fit_model(docs.where("doc_id % 5 <> 0"))
    held = score_texts(docs.where("doc_id % 5 = 0"), model).agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_only_mounted_folders_can_be_mapped():
    assert mounted("file:///a/b%20c") == "/a/b c" and mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        mounted("hdfs://host/a")


def test_the_query_scores_with_two_words_of_history(spark, tmp_path):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    brute = Brute([t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2], 3)
    for row in op10_language_model_scores(spark, str(tmp_path)).collect():
        assert math.isclose(row["score"], brute.score(dict(rows)[row["doc_id"]]), rel_tol=1e-9)


def test_keys_counts_and_sums_are_found_again(tmp_path):
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 64, 60_000, dtype=np.uint64))
    keys[:3] = [0, 1, 1 << 20]
    keys[-1] = (1 << 64) - 1
    counts = draw.choice([1, 2, 254, 255, 256, (1 << 32) - 1, 1 << 32, 1 << 40], len(keys))
    more = draw.integers(0, 300, (len(keys), 3)) * draw.integers(0, 2, (len(keys), 3))
    more[::2] %= 9
    sums = np.column_stack([more @ [1, 2, 3] + (more[:, 2] > 0) * counts, more])
    for shard in range(64):
        own = keys >> np.uint64(58) == shard
        keep_shard(f"{tmp_path}/gram{shard}", 6, keys[own], count=(Counts, counts[own]), sums=(Sums, sums[own]))
    absent = np.setdiff1d(np.concatenate([keys + np.uint64(1), draw.integers(0, 1 << 64, 1000, dtype=np.uint64)]), keys)
    asked = draw.permutation(np.concatenate([keys, absent]))
    there, found = Shelf(str(tmp_path), "gram", 6, {"count": Counts, "sums": Sums}).find(asked)
    at = np.searchsorted(keys, asked) % len(keys)
    assert (there == (keys[at] == asked)).all()
    assert (found[0] == np.where(there, counts[at], 0)).all()
    assert (found[1] == np.where(there[:, None], sums[at], 0)).all()


@pytest.mark.parametrize("level", [1, 2, 3])
def test_packed_rows_come_back(level):
    ids = np.random.default_rng(level).integers(0, 1 << 32, (1000, level), dtype=np.uint32)
    ids = ids[np.argsort(ids[:, 0])]
    assert (unpack(pack(ids), 1000, level) == ids).all()


def test_word_numbers_that_do_not_fit_are_refused():
    assert past_numbers((1 << 26) - 1, 6) == (1 << 32) - 64
    with pytest.raises(ValueError, match="32 bits"):
        past_numbers(1 << 26, 6)


def test_many_keys_of_a_shard_take_five_bytes(tmp_path):
    rng = np.random.default_rng(7)
    for bits, n in ((6, 400_000), (6, 3_000), (6, 0), (7, 200_000), (12, 5_000)):
        folder = tmp_path / f"{bits}-{n}"
        top = np.uint64(5) << np.uint64(64 - bits)
        random = rng.integers(0, 1 << (64 - bits), n + n // 2, dtype=np.uint64)
        crowded = np.arange(min(n, 700), dtype=np.uint64)  # one part of the finer table holds more than a byte counts
        pool = np.unique(np.concatenate([random, crowded])) | top
        taken = rng.random(len(pool)) < 2 / 3
        keys, absent = pool[taken], pool[~taken]
        keep_shard(f"{folder}/x5", bits, keys, count=(Counts, np.arange(len(keys)) % 9 + 1))
        there, (counts,) = Shelf(str(folder), "x", bits, {"count": Counts}).find(np.concatenate([absent, keys[::-1]]))
        assert not there[: len(absent)].any() and there[len(absent) :].all()
        assert (counts[len(absent) :] == (np.arange(len(keys)) % 9 + 1)[::-1]).all()
        if n > 100_000 or bits == 12:
            assert (folder / "x5-high").stat().st_size == len(keys)  # two bytes a key before


def test_sorted_keys_travel_as_steps():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    assert (unpack_keys(pack_keys(keys), len(keys)) == keys).all()
    assert len(pack_keys(keys)) < 7 * len(keys)
    assert len(unpack_keys(pack_keys(keys[:0]), 0)) == 0


def test_a_model_of_many_shards_maps_few_files(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 1)
    model = fit_model(spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3))
    assert model.bits == 8
    files = [f for _, _, names in os.walk(model.folder) for f in names]
    assert len(files) <= 64 * 8  # one for each volume and shelf
    brute, soft = Brute(TRAIN, 3), resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 16, soft[1]))
    try:
        for _, _, data, offsets in text_slices(pa.array(["" if t is None else t for t in TEXTS]), 1 << 20):
            hashes, bounds = kneser_ney._word_hashes(data, offsets)
            found = np.add.reduceat(model.log10(model.numbers(hashes)[0], bounds), bounds[:-1])
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, soft)
    assert np.allclose(found, [brute.score(t) for t in TEXTS], rtol=1e-9)


def test_bound_shards_are_found_like_single_ones(tmp_path):
    rng, bits, inner = np.random.default_rng(9), 6, 2
    # many keys with a finer table, few without one, none at all; the second volume has few keys only
    rows = [300_000, 2_000, 0, 400_000, 0, 500, 0, 90] + [0] * 56
    columns = {"count": Counts, "sums": Sums, "rank": kneser_ney.Numbers}
    all_keys, all_counts = [], []
    for shard, n in enumerate(rows):
        keys = np.unique(rng.integers(0, 1 << (64 - bits), n, dtype=np.uint64)) | np.uint64(shard) << np.uint64(64 - bits)
        counts = rng.choice([1, 2, 254, 255, 70_000, 1 << 40], len(keys))
        sums = np.column_stack([counts, counts % 7, counts % 5, counts % 3])
        sums[:, 0] = np.where(sums[:, 3] == 0, sums[:, 1] + 2 * sums[:, 2], counts)
        if n:
            path = kneser_ney.shard_path(str(tmp_path), "x", shard)
            keep_shard(path, bits, keys, count=(Counts, counts), sums=(Sums, sums), rank=(kneser_ney.Numbers, np.arange(len(keys))))
        all_keys.append(keys)
        all_counts.append(np.column_stack([counts, np.arange(len(keys)), sums]))
    for _ in range(2):  # a repeated task finds the shards gone and changes nothing
        for volume in range(1 << (bits - inner)):
            kneser_ney.bind_shards(str(tmp_path), "x", volume, bits, inner, columns)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["shards", "x0", "x1"] and not os.listdir(tmp_path / "shards")
    keys, expected = np.concatenate(all_keys), np.concatenate(all_counts)
    absent = np.setdiff1d(np.concatenate([keys[::50] + np.uint64(1), rng.integers(0, 1 << 64, 1000, dtype=np.uint64)]), keys)
    asked = rng.permutation(np.concatenate([keys, absent]))
    there, (count, sums, rank) = Shelf(str(tmp_path), "x", bits - inner, columns, inner).find(asked)
    at = np.searchsorted(keys, asked) % len(keys)
    assert (there == (keys[at] == asked)).all()
    for found, column in ((count, expected[:, 0]), (rank, expected[:, 1]), (sums, expected[:, 2:])):
        known = there if found.ndim == 1 else there[:, None]
        assert (found == np.where(known, column[at], 0)).all()
