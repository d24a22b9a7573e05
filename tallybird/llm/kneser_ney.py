"""Language-model scoring: interpolated modified Kneser-Ney counted in Spark, mapped by workers.

Tokens are words (runs of anything but white space, A-Z lowered) and one end per text.

1. Every task counts the words of its training texts; counts meet in shards of the word hash. A shard
   becomes a file of sorted hashes and counts in the shared folder. A word's number is its rank by
   count within the shard, followed by the shard: frequent words have small numbers.
2. Tasks map those files, number the words of their texts and count n-grams, which travel packed:
   sorted by their first word, that word delta-coded, in planes of bytes. A shard holds all n-grams
   of its histories, so that what follows a history is summed up and written where it lies; n-grams
   whose history has only hot words are dealt by the whole n-gram, and only sums of such histories
   travel. Shards become sorted files too: six bytes a key, one a count, larger ones beside them.
   The continuation counts of the next lower order come out of the shards of the higher one, in the
   same job: nothing is staged.
   The files of up to 16 neighbouring shards are then bound into one volume file, so that a worker
   maps few files also of a model of thousands of shards, and looks up many keys at once.
3. Tasks map all files and score whole texts. No table is held in memory or passes the driver; it
   gets the names of files, sums, counts of counts and the hot words, a bounded list.

Files are written under another name and moved when complete, so a repeated task does no harm.
The order is a parameter; the number of shards follows the size of the texts.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallybird.llm.staging import new_folder
from tallybird.llm.texts import whole_text
from tallybird.llm.tokens import LOWER, WORDS, mix, random_words, text_slices, tokenise

ORDER = 3
SHARD_BYTES = 8 << 20  # of text for each shard
END = random_words(1, 101)[0]  # the hash of the end token
_FLUSH = 1 << 22
_SLICE = 4 << 20
_BUCKET_BITS = 13
_VOLUMES = 6  # bits: fewer volumes are not made
_INNER = 4  # bits of a shard's number within a volume, at most
_OPEN = 4096  # volumes of a shelf that a worker holds mapped
_REST_BITS = 40  # of a key in five bytes


def mounted(path: str) -> str:
    """The path as workers open it; memory mapping needs a shared folder that is mounted."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: models are memory-mapped, spark.checkpoint.dir must name a mounted folder")
    return unquote(parts.path)


def put(path: str, column: np.ndarray) -> None:
    """A file that is complete or absent under its name."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    folder, name = os.path.split(path)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    column.tofile(draft)
    os.replace(draft, path)


def _mapped(path: str, kind: type) -> np.ndarray:
    """The file as an array; no descriptor stays open."""
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.empty(0, kind)
    with pa.memory_map(path) as file:
        return np.frombuffer(file.read_buffer(), kind)


#: Stores the column of a name; gives the column of a name, empty if there is none.
Put = Callable[[str, np.ndarray], None]
Read = Callable[[str, type], np.ndarray]


def put_volume(path: str, columns: dict[str, np.ndarray]) -> None:
    """One file of all columns: each from a multiple of eight bytes, then where they are. A file that
    is there already is complete and stays: the one who wrote it may have removed what it is made of."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    folder, name = os.path.split(path)
    draft, index = f"{folder}/.{name}-{uuid.uuid4().hex}", {}
    with open(draft, "wb") as file:
        for key, column in columns.items():
            file.write(b"\0" * (-file.tell() % 8))
            index[key] = (file.tell(), column.nbytes)
            file.write(np.ascontiguousarray(column).view(np.uint8).reshape(-1).data)
        end = json.dumps(index).encode()
        file.write(end + len(end).to_bytes(8, "little"))
    if os.path.exists(path):
        os.remove(draft)
    else:
        os.replace(draft, path)


def opened(path: str) -> Read:
    """Columns of a volume, or of a shard that is files of its own."""
    data = _mapped(path, np.uint8)
    if not len(data):
        return lambda name, kind: _mapped(f"{path}-{name}", kind)
    size = int.from_bytes(data[-8:].tobytes(), "little")
    index = json.loads(data[-8 - size : -8].tobytes())

    def read(name: str, kind: type) -> np.ndarray:
        start, length = index.get(name, (0, 0))
        return data[start : start + length].view(kind)

    return read


class Keys:
    """Sorted distinct 64-bit keys of a shard of at least ``16 - _BUCKET_BITS`` bits: where each value
    of the next ``_BUCKET_BITS`` bits starts, and the rest of each key, in five bytes if it fits. Where
    it does not and keys are many, a finer table (places within a bucket) takes up the bits too many;
    few keys take six bytes. Shards of a volume stand one behind the other, as one shard of fewer bits
    with as many more bits for buckets."""

    @staticmethod
    def keep(put: Put, rows: int, shards: Iterable[np.ndarray], bits: int, inner: int = 0) -> None:
        """``rows`` keys in all, by shard; there are ``1 << inner`` shards."""
        finer = max(0, 64 - bits - _BUCKET_BITS - _REST_BITS)
        finer = finer if rows > 1 << (_BUCKET_BITS + finer + inner) else 0
        kept = 64 - bits - _BUCKET_BITS - finer
        wide = np.uint8 if kept <= _REST_BITS else np.uint16
        sizes, within, high, low = [], [], [], []
        for keys in shards:
            part = ((keys << np.uint64(bits)) >> np.uint64(64 - _BUCKET_BITS - finer)).astype(np.int64)
            own = np.bincount(part, minlength=1 << (_BUCKET_BITS + finer)).reshape(-1, 1 << finer)
            sizes.append(own.sum(1))
            if finer:
                inside = (np.cumsum(own, axis=1) - own).ravel()
                within.append(inside.astype(np.min_scalar_type(inside.max())))
            rest = keys & np.uint64((1 << kept) - 1)
            high.append((rest >> np.uint64(32)).astype(wide))
            low.append(rest.astype(np.uint32))
        put("at", np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.uint32 if rows < 1 << 32 else np.int64))
        if finer:
            put("within", np.concatenate(within))
        put("high", np.concatenate(high))
        put("low", np.concatenate(low))

    def __init__(self, read: Read, bits: int, inner: int = 0):
        self.bits, self.low = bits, read("low", np.uint32)
        self.buckets = _BUCKET_BITS + inner
        self.starts = self._sized(read("at", np.uint8), (1 << self.buckets) + 1)
        self.finer = max(0, 64 - bits - self.buckets - _REST_BITS)
        self.within = self._sized(read("within", np.uint8), 1 << (self.buckets + self.finer))
        self.high = self._sized(read("high", np.uint8), len(self.low))
        self.rest = 64 - bits - self.buckets if not len(self.within) else _REST_BITS

    @staticmethod
    def _sized(column: np.ndarray, rows: int) -> np.ndarray:
        """A column of ``rows`` unsigned numbers of the width that its size tells."""
        return column.view(f"u{len(column) // rows}") if len(column) else column

    def at(self, places: np.ndarray) -> np.ndarray:
        return (self.high[places].astype(np.uint64) << np.uint64(32)) | self.low[places]

    def all(self, number: int) -> np.ndarray:
        """The keys as they were, of the shard of this number."""
        if not len(self.low):
            return np.empty(0, np.uint64)
        starts = self.starts.astype(np.int64)
        if len(self.within):
            starts = np.append(np.repeat(starts[:-1], 1 << self.finer) + self.within, len(self.low))
        above = np.arange(len(starts) - 1, dtype=np.uint64) << np.uint64(self.rest)
        above |= np.uint64(number) << np.uint64(64 - self.bits)
        return np.repeat(above, np.diff(starts)) | (self.high.astype(np.uint64) << np.uint64(32)) | self.low

    def bounds(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which places each key must lie."""
        bucket = ((keys << np.uint64(self.bits)) >> np.uint64(64 - self.buckets)).astype(np.int64)
        low, high = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        if not len(self.within):
            return low, high
        part = ((keys << np.uint64(self.bits)) >> np.uint64(64 - self.buckets - self.finer)).astype(np.int64) + 1
        inner = part & ((1 << self.finer) - 1) != 0  # the last part ends with its bucket
        high = np.where(inner, low + self.within[np.where(inner, part, 0)], high)
        return low + self.within[part - 1], high

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key of this shard, -1 if absent."""
        if not len(self.low):
            return np.full(len(keys), -1, np.int64)
        rest = keys & np.uint64((1 << self.rest) - 1)
        low, high = self.bounds(keys)
        end = high.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (low < high) & (self.at(np.minimum(middle, len(self.low) - 1)) < rest)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        inside = np.minimum(low, len(self.low) - 1)
        return np.where((low < end) & (self.at(inside) == rest), low, -1)


class Numbers:
    """A plain column of 32-bit numbers."""

    width = ()

    @staticmethod
    def keep(put: Put, name: str, column: np.ndarray) -> None:
        put(name, column.astype(np.uint32))

    @staticmethod
    def gather(put: Put, name: str, parts: list[Numbers]) -> None:
        put(name, np.concatenate([part.column for part in parts]))

    def __init__(self, read: Read, name: str):
        self.column = read(name, np.uint32)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.column[at].astype(np.int64)


def _moved(places: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Places within parts of these sizes as places in all of them."""
    return np.concatenate([own + before for own, before in zip(places, np.cumsum([0, *sizes]))])


class Counts:
    """A column of counts: one byte each, and those that need more as places and values."""

    width = ()

    @staticmethod
    def keep(put: Put, name: str, column: np.ndarray) -> None:
        wide = np.flatnonzero(column >= 255)
        if len(wide):
            put(f"{name}-wide", np.stack([wide, column[wide].astype(np.int64)]))
        put(name, np.minimum(column, 255).astype(np.uint8))

    @staticmethod
    def gather(put: Put, name: str, parts: list[Counts]) -> None:
        places = _moved([part.places for part in parts], [len(part.narrow) for part in parts])
        if len(places):
            put(f"{name}-wide", np.stack([places, np.concatenate([part.wide for part in parts])]))
        put(name, np.concatenate([part.narrow for part in parts]))

    def __init__(self, read: Read, name: str):
        self.narrow = read(name, np.uint8)
        self.places, self.wide = read(f"{name}-wide", np.int64).reshape(2, -1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.narrow[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self.wide[np.searchsorted(self.places, at[large])]
        return out


class Sums:
    """Four sums of each history: its counts, how many are 1, 2 and more. Without counts over 2, and
    with few of 1 and 2, one byte says all; the others have their place and four ``Counts``."""

    width = (4,)

    @staticmethod
    def keep(put: Put, name: str, sums: np.ndarray) -> None:
        _, one, two, more = sums.T
        small = (more == 0) & (one < 32) & (two < 7)
        put(name, np.where(small, one + 32 * two, 255).astype(np.uint8))
        rest = np.flatnonzero(~small)
        put(f"{name}-places", rest)
        for k in range(4):
            Counts.keep(put, f"{name}-{k}", sums[rest, k])

    @staticmethod
    def gather(put: Put, name: str, parts: list[Sums]) -> None:
        put(name, np.concatenate([part.code for part in parts]))
        put(f"{name}-places", _moved([part.places for part in parts], [len(part.code) for part in parts]))
        for k in range(4):
            Counts.gather(put, f"{name}-{k}", [part.rest[k] for part in parts])

    def __init__(self, read: Read, name: str):
        self.code, self.places = read(name, np.uint8), read(f"{name}-places", np.int64)
        self.rest = [Counts(read, f"{name}-{k}") for k in range(4)]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        code = self.code[at].astype(np.int64)
        one, two = code % 32, code // 32
        out = np.stack([one + 2 * two, one, two, np.zeros_like(code)], axis=1)
        other = np.flatnonzero(code == 255)
        if len(other):
            places = np.searchsorted(self.places, at[other])
            out[other] = np.stack([column[places] for column in self.rest], axis=1)
        return out


def keep_shard(path: str, bits: int, keys: np.ndarray, **columns: tuple[type, np.ndarray]) -> None:
    def keep(name: str, column: np.ndarray) -> None:
        put(f"{path}-{name}", column)

    for name, (kind, column) in columns.items():
        kind.keep(keep, name, column)
    Keys.keep(keep, len(keys), [keys], bits)


def shard_path(folder: str, name: str, shard: int) -> str:
    """Where ``keep_shard`` leaves a shard that is to be bound: a folder of its own."""
    return f"{folder}/shards/{name}{shard}/column"


def bind_shards(folder: str, name: str, volume: int, bits: int, inner: int, columns: dict[str, type]) -> None:
    """One volume of ``1 << inner`` shards of ``bits`` bits; their files go."""
    numbers = range(volume << inner, (volume + 1) << inner)
    paths = [shard_path(folder, name, number) for number in numbers]
    if not os.path.exists(f"{folder}/{name}{volume}"):
        reads = [opened(path) for path in paths]
        keys = [Keys(read, bits) for read in reads]
        rows, found = sum(len(own.low) for own in keys), {}
        if rows:
            Keys.keep(found.__setitem__, rows, (own.all(number) for own, number in zip(keys, numbers)), bits, inner)
            for column, kind in columns.items():
                kind.gather(found.__setitem__, column, [kind(read, column) for read in reads])
            put_volume(f"{folder}/{name}{volume}", found)
    for path in paths:
        shutil.rmtree(os.path.dirname(path), ignore_errors=True)


class Shelf:
    """Sorted 64-bit keys with columns, mapped files for each volume: the top ``bits`` bits. A volume
    holds ``1 << inner`` shards."""

    def __init__(self, folder: str, name: str, bits: int, columns: dict[str, type], inner: int = 0):
        self.bits, self.kinds, self.inner = bits, columns, inner
        self.path = f"{folder}/{name}"
        self.maps: dict[int, list] = {}

    def volume(self, number: int) -> list:
        if number not in self.maps:
            if len(self.maps) >= _OPEN:
                del self.maps[next(iter(self.maps))]
            read = opened(f"{self.path}{number}")
            columns = [kind(read, name) for name, kind in self.kinds.items()]
            self.maps[number] = [Keys(read, self.bits, self.inner), *columns]
        return self.maps[number]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is there and its columns (0: absent)."""
        order = None if (keys[1:] >= keys[:-1]).all() else np.argsort(keys)
        ordered = keys if order is None else keys[order]
        there = np.zeros(len(keys), bool)
        values = [np.zeros((len(keys), *kind.width), np.int64) for kind in self.kinds.values()]
        firsts = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        cuts = np.append(np.searchsorted(ordered, firsts), len(ordered))
        for number in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[number], cuts[number + 1]
            known, *columns = self.volume(number)
            at = known.find(ordered[a:b])
            hit = np.flatnonzero(at >= 0)
            own = hit + a if order is None else order[a:b][hit]
            there[own] = True
            for value, column in zip(values, columns):
                value[own] = column[at[hit]]
        return there, values


def gram_hash(ids: np.ndarray) -> np.ndarray:
    """A hash of rows of word numbers; without collisions up to two words."""
    if ids.shape[1] == 0:
        return np.zeros(len(ids), np.uint64)
    key = ids[:, 0].astype(np.uint64)
    for k in range(1, ids.shape[1]):
        key = mix(key) if k > 1 else key
        key = (key << np.uint64(32) if k == 1 else key * np.uint64(0x9E3779B97F4A7C15)) + ids[:, k].astype(np.uint64)
    return mix(key)


def spread(ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which rows have a history of hot words only."""
    return np.isin(ids[:, :-1], hot).all(1)


def address(ids: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Shard in the top bits (that of the history, or of the n-gram behind a hot history), hash below."""
    whole = gram_hash(ids)
    if ids.shape[1] == 1:
        return whole
    history = gram_hash(ids[:, :-1])
    if len(hot):
        history = np.where(spread(ids, hot), whole, history)
    return (history >> np.uint64(64 - bits) << np.uint64(64 - bits)) | (whole >> np.uint64(bits))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sorted keys, sums, index of a row of each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0], order[first]


_CHUNK = "kind string, shard int, keys binary, counts binary, n int"


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: their steps in planes of bytes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_keys(packed: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, rows * 8, "zstd"), np.uint8).reshape(8, rows)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _unpacked_chunks(table: pa.Table, kind: type, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts (``width`` to a key) of all rows of ``_chunks``."""
    rows = table.column("n").to_pylist()
    size = np.dtype(kind).itemsize * width
    keys = [unpack_keys(x.as_py(), n) for x, n in zip(table.column("keys"), rows)]
    counts = [np.frombuffer(pa.decompress(x.as_py(), n * size, "zstd"), kind) for x, n in zip(table.column("counts"), rows)]
    return np.concatenate(keys), np.concatenate(counts)


def _chunks(kind: str, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows cut by shard from sorted ``keys``, packed, with their counts."""
    shards = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(shards, np.arange((1 << bits) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(full), pa.string()),
            pa.array(full.astype(np.int32)),
            pa.array([pack_keys(keys[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
            pa.array([pa.compress(counts[cuts[s] : cuts[s + 1]].tobytes(), "zstd", asbytes=True) for s in full], pa.binary()),
            pa.array(np.diff(cuts)[full].astype(np.int32)),
        ],
        names=["kind", "shard", "keys", "counts", "n"],
    )


def pack(ids: np.ndarray) -> bytes:
    """Rows of word numbers, ordered by the first: its steps and the others in planes of bytes, compressed."""
    ids = ids.copy()
    ids[1:, 0] -= ids[:-1, 0].copy()
    planes = np.ascontiguousarray(ids.view(np.uint8).reshape(len(ids), -1).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, rows: int, level: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, rows * level * 4, "zstd"), np.uint8).reshape(-1, rows)
    ids = np.ascontiguousarray(planes.T).view(np.uint32)
    ids[:, 0] = np.cumsum(ids[:, 0], dtype=np.uint32)
    return ids


def _gram_chunks(level: int, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Packed rows cut by shard from n-grams with sorted ``keys``."""
    cuts = np.searchsorted((keys >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    full = np.flatnonzero(np.diff(cuts))
    packed, times = [], []
    for shard in full.tolist():
        own = slice(cuts[shard], cuts[shard + 1])
        # words behind the same word in order, too: their upper bytes repeat
        order = np.argsort(ids[own, 0].astype(np.uint64) << np.uint64(32) | ids[own, min(1, level - 1)])
        packed.append(pack(ids[own][order]))
        times.append(counts[own][order].astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"gram{level}"] * len(full), pa.string()),
            pa.array(full.astype(np.int32)),
            pa.array(packed, pa.binary()),
            pa.array([pa.compress(x, "zstd", asbytes=True) for x in times], pa.binary()),
            pa.array(np.diff(cuts)[full].astype(np.int32)),
        ],
        names=["kind", "shard", "keys", "counts", "n"],
    )


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and their bounds."""
    words = tokenise(data, offsets, WORDS, LOWER)
    texts = len(offsets) - 1
    bounds = words.bounds + np.arange(texts + 1)
    out = np.empty(len(words.hashes) + texts, np.uint64)
    ends = bounds[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends] = END
    out[inner] = words.hashes
    return out, bounds


def _count_words(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, counts, _ = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return _chunks("word", keys, counts.astype(np.uint32), bits)

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("t"), _SLICE):
                held.append(np.unique(_word_hashes(data, offsets)[0], return_counts=True))
                if sum(len(k) for k, _ in held) > _FLUSH:
                    yield flush()
        if held:
            yield flush()

    return count


def _keep_words(folder: str, bits: int):
    def keep(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _unpacked_chunks(table, np.uint32)
        keys, counts, _ = summed(keys, counts.astype(np.int64))
        by_count = np.argsort(-counts, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[by_count] = np.arange(len(keys))
        keep_shard(shard_path(folder, "word", shard), bits, keys, count=(Counts, counts), rank=(Numbers, rank))
        # counts of the most frequent words: whoever is hot is among them
        top = by_count[:4]
        return pa.table(
            {
                "shard": pa.array([shard], pa.int32()),
                "words": [len(keys)],
                "tokens": [int(counts.sum())],
                "top": pa.array([counts[top].tolist()], pa.list_(pa.int64())),
            }
        )

    return keep


#: The columns of each kind of shelf.
SHELVES = {"word": {"count": Counts, "rank": Numbers}, "gram": {"count": Counts}, "history": {"sums": Sums}, "hot": {"sums": Sums}}


def inner_bits(bits: int) -> int:
    """A volume holds this power of two of shards: one, until there are more volumes than ``_VOLUMES``
    tells."""
    return min(_INNER, max(0, bits - _VOLUMES))


def bind(spark: SparkSession, folder: str, bits: int, names: list[str]) -> None:
    """All shards of the named shelves into volumes, a task for each part of the keys."""
    inner = inner_bits(bits)
    volumes = 1 << (bits - inner)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for volume in batch.column(0).to_pylist():
                for name in names:
                    bind_shards(folder, name, volume, bits, inner, SHELVES[name.rstrip("-0123456789")])
            yield batch

    spark.range(0, volumes, 1, volumes).mapInArrow(bound, "id long").agg(F.count("id")).collect()


@dataclass
class Model:
    """Names and sums; the tables are files."""

    folder: str
    bits: int
    order: int
    words: int  # V
    tokens: int  # N
    before: int  # past the numbers of all words; stands for what is before a text
    hot: np.ndarray
    discounts: dict[int, np.ndarray] = field(default_factory=dict)  # by order, for counts 1, 2, 3 and more
    unigram: tuple[float, float] = (0.0, 0.0)  # sum of continuation counts, weight of the uniform part

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "shelves"}

    def shelf(self, name: str) -> Shelf:
        shelves = self.__dict__.setdefault("shelves", {})
        if name not in shelves:
            inner = inner_bits(self.bits)
            shelves[name] = Shelf(self.folder, name, self.bits - inner, SHELVES[name.rstrip("-0123456789")], inner)
        return shelves[name]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, training count) of each token; unknown tokens have the number after ``before`` and
        count 0."""
        distinct, back = np.unique(hashes, return_inverse=True)
        known, (counts, rank) = self.shelf("word").find(distinct)
        shard = (distinct >> np.uint64(64 - self.bits)).astype(np.int64)
        number = np.where(known, (rank << self.bits) | shard, self.before + 1)
        return number[back], counts[back]

    def grams(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row of ``order`` word numbers for every token, ``before`` ahead of the text."""
        n = self.order
        ids = np.empty((len(numbers), n), np.uint32)
        position = np.arange(len(numbers)) - np.repeat(bounds[:-1], np.diff(bounds))
        for back in range(n):
            column = np.roll(numbers, back)
            ids[:, n - 1 - back] = np.where(position >= back, column, self.before)
        return ids

    def discount(self, level: int, counts: np.ndarray) -> np.ndarray:
        return self.discounts[level][np.minimum(counts, 3).astype(np.int64)]

    def log10(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of the interpolated probability of every token."""
        ids = self.grams(numbers, bounds)
        total, uniform = self.unigram
        chance = np.full(len(ids), 1.0 / (self.words + 1))
        # single words repeat most: put in order once, as n-grams of order 1 and as histories of order 2
        words, word = np.unique(ids[:, -1], return_inverse=True)
        for level in range(1, self.order + 1):
            own = ids[:, self.order - level :]
            if level == 1:
                keys, back = address(words[:, None], self.bits, self.hot), word
            else:
                keys, back = np.unique(address(own, self.bits, self.hot), return_inverse=True)
            (count,) = self.shelf(f"gram{level}-").find(keys)[1]
            kept = np.maximum(count - self.discount(level, count), 0.0)[back]
            if level == 1:
                if total:
                    chance = kept / total + uniform * chance
                continue
            # a history is in one of them: among the hot ones if all of its words are hot
            if level == 2:
                before = np.append(words, np.uint32(self.before))
                histories, parted = gram_hash(before[:, None]), np.isin(before, self.hot)
                behind = np.roll(word, 1)
                behind[bounds[:-1]] = len(words)
            else:
                histories, behind = np.unique(gram_hash(own[:, :-1]), return_inverse=True)
                parted = np.zeros(len(histories), bool)
                parted[behind[spread(own, self.hot)]] = True
            found = np.empty((len(histories), 4), np.int64)
            for name, which in (("history", ~parted), ("hot", parted)):
                found[which] = self.shelf(f"{name}{level}-").find(histories[which])[1][0]
            found = found.T
            seen = found[0][behind].astype(np.float64)
            rest = sum(d * n[behind] for d, n in zip(self.discounts[level][1:], found[1:]))
            known = seen > 0
            scale = np.where(known, seen, 1.0)
            chance = np.where(known, kept / scale + rest / scale * chance, chance)
        return np.log10(chance)


def _count_grams(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            keys, counts, at = summed(address(ids, model.bits, model.hot), np.ones(len(ids), np.int64))
            return _gram_chunks(model.order, keys, ids[at], counts, model.bits)

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("t"), _SLICE):
                hashes, bounds = _word_hashes(data, offsets)
                held.append(model.grams(model.numbers(hashes)[0], bounds))
                if sum(map(len, held)) > _FLUSH:
                    yield flush()
        if held:
            yield flush()

    return count


def _sums(which: np.ndarray, counts: np.ndarray, histories: int) -> np.ndarray:
    """By history: sum of the counts, numbers of counts 1, 2 and more; exact in int64."""
    columns = [counts] + [x.astype(np.int64) for x in (counts == 1, counts == 2, counts > 2)]
    out = np.zeros((histories, 4), np.int64)
    for k, column in enumerate(columns):
        np.add.at(out[:, k], which, column)
    return out


def _keep_grams(model: Model, level: int):
    """A shard of order ``level``: its file, its histories, what the order below counts. Sums of hot
    histories, cut out of the order above, meet in their own files; counts of counts pass on."""

    def keep(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        if kind.startswith("counts"):
            return table
        if kind.startswith("hot"):
            keys, sums = _unpacked_chunks(table, np.int64, 4)
            sums = sums.reshape(-1, 4)
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            sums = np.add.reduceat(sums[order], first, axis=0)
            keep_shard(shard_path(model.folder, f"{kind}-", shard), model.bits, keys[order][first], sums=(Sums, sums))
            return table.slice(0, 0)
        rows = table.column("n").to_pylist()
        ids = np.concatenate([unpack(x.as_py(), n, level) for x, n in zip(table.column("keys"), rows)])
        counts = np.concatenate(
            [np.frombuffer(pa.decompress(x.as_py(), n * 4, "zstd"), np.uint32) for x, n in zip(table.column("counts"), rows)]
        )
        keys, counts, at = summed(address(ids, model.bits, model.hot), counts.astype(np.int64))
        ids = ids[at]
        keep_shard(shard_path(model.folder, f"gram{level}-", shard), model.bits, keys, count=(Counts, counts))
        of_counts = np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [counts.sum(), (counts > 2).sum()], np.int64)
        out = [
            pa.RecordBatch.from_arrays(
                [
                    pa.array([f"counts{level}"]),
                    pa.array([shard], pa.int32()),
                    pa.array([b""], pa.binary()),
                    pa.array([of_counts.tobytes()], pa.binary()),
                    pa.array([1], pa.int32()),
                ],
                names=["kind", "shard", "keys", "counts", "n"],
            )
        ]
        if level > 1:
            parted = spread(ids, model.hot)
            for name, own in (("history", ~parted), ("hot", parted)):
                history, which = np.unique(gram_hash(ids[own, :-1]), return_inverse=True)
                sums = _sums(which, counts[own], len(history))
                if name == "history":  # whole in this shard
                    keep_shard(shard_path(model.folder, f"history{level}-", shard), model.bits, history, sums=(Sums, sums))
                elif len(history):
                    out.append(_chunks(f"hot{level}", history, sums, model.bits))
            lower = ids[:, 1:]
            key, times, row = summed(address(lower, model.bits, model.hot), np.ones(len(lower), np.int64))
            out.append(_gram_chunks(level - 1, key, lower[row], times, model.bits))
        return pa.Table.from_batches(out)

    return keep


def discounts_from(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more (Chen and Goodman), within [0, count]. Where too
    few counts are seen to estimate one, it is 0.75 of Kneser and Ney's."""
    n = [float(x) for x in counts_of_counts[:4]]
    if n[0] <= 0 or n[0] + 2 * n[1] <= 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    out = [0.0]
    for k in (1, 2, 3):
        value = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] > 0 else 0.75
        out.append(min(max(value, 0.0), float(k)))
    return np.array(out)


def past_numbers(words: int, bits: int) -> int:
    """The first number after those of all words, with at most ``words`` in a shard. It and the next
    one, for unknown words, must fit 32 bits."""
    before = words << bits
    if before + 1 >= 1 << 32:
        raise ValueError(f"{words} words in one of {1 << bits} shards need numbers of more than 32 bits")
    return before


def fit_model(texts: DataFrame, text: str = "text", order: int = ORDER, folder: str | None = None) -> Model:
    """Count ``texts``, all of them, and leave the tables in ``folder`` (a new one in the shared
    folder by default). Null texts count as empty: one end token. Without rows the model is uniform
    over the unknown word."""
    spark = texts.sparkSession
    folder = mounted(folder or new_folder(spark, "ngrams"))
    words = texts.select(whole_text(texts, text).alias("t"))
    size = words.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    shards = (
        words.mapInArrow(_count_words(bits), _CHUNK)
        .groupBy("shard")
        .applyInArrow(_keep_words(folder, bits), "shard int, words long, tokens long, top array<long>")
        .collect()  # a few numbers per shard
    )
    bind(spark, folder, bits, ["word"])
    words_of = {row["shard"]: row["words"] for row in shards}
    before = past_numbers(max(words_of.values(), default=0), bits)
    tokens = sum(row["tokens"] for row in shards)
    bound = tokens / (1 << bits) / 4
    hot = [
        (rank << bits) | row["shard"]
        for row in shards
        for rank, times in enumerate(row["top"])
        if times > bound
    ]
    model = Model(folder, bits, order, sum(words_of.values()), tokens, before, np.array([*hot, before], np.uint32))
    chunks = words.mapInArrow(_count_grams(model), _CHUNK)
    for level in range(order, 0, -1):
        chunks = chunks.groupBy("kind", "shard").applyInArrow(_keep_grams(model, level), _CHUNK)
    totals = {level: np.zeros(6, np.int64) for level in range(1, order + 1)}
    for row in chunks.select("kind", "counts").collect():  # a few numbers per shard and order
        totals[int(row["kind"].removeprefix("counts"))] += np.frombuffer(bytes(row["counts"]), np.int64)
    tables = [f"gram{level}-" for level in totals] + [f"{name}{level}-" for level in totals if level > 1 for name in ("history", "hot")]
    bind(spark, folder, bits, tables)
    for level, total in totals.items():
        model.discounts[level] = discounts_from(total)
    spent = model.discounts[1][1:] @ np.array([totals[1][0], totals[1][1], totals[1][5]], np.float64)
    model.unigram = float(totals[1][4]), float(spent / totals[1][4]) if totals[1][4] else 0.0
    return model


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score of the whole text. A null
    or empty text is its end token alone; repeated rows score alike; other columns pass through,
    except that names of the new columns must be free."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for low, high, data, offsets in text_slices(column, _SLICE):
                hashes, bounds = _word_hashes(data, offsets)
                numbers, counts = own.numbers(hashes)
                base = np.log10((counts + 1) / (own.tokens + own.words + 1))
                starts = bounds[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(low, high - low) for c in batch.columns],
                        pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                        pa.array(np.full(high - low, own.tokens)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(own.log10(numbers, bounds), starts)),
                    ],
                    names=[*batch.schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    whole = [StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
    scores = [StructField(c, DoubleType()) for c in ("base_score", "score")]
    return docs.mapInArrow(score, StructType([*docs.schema.fields, *whole, *scores]))


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
