"""Token ids of whole texts in binary files: fixed-size blocks, transposed into planes, each compressed.

A file holds the ids of many documents one after another. Blocks of ``BLOCK`` ids are transposed into bit
planes (bit k of every id) or byte planes; planes of zeros take no room, the others are compressed with
zstandard on their own. The file ends with its documents, an index of all chunks and a trailer of
fixed size, so a reader finds any range of ids by reading only the chunks that hold it.

Documents go out in ascending id: ranges of ids are dealt to tasks and each task writes the files of its
range, named by range and place. A file is complete or absent under its name, so a task that runs again
writes the same file again.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybird.llm.kneser_ney import mounted
from tallybird.llm.staging import new_folder
from tallybird.llm.texts import whole_text
from tallybird.llm.tokens import text_slices

BLOCK = 1 << 16  # ids of a chunk
FILE_IDS = 1 << 26  # a file ends with the document that reaches this
RANGE = 64 << 20  # bytes of text of a task
SLICE = 8 << 20  # bytes of text worked on at once
KNOWN = 1_000_000  # pieces of text whose ids a task keeps
_WORDS_AT_ONCE = 20_000
_READ_BYTES = 8 << 20

MAGIC = b"IDPLANE1"
#: Ids, documents, chunks, ids of a chunk, planes of a chunk, bytes of the three parts about documents.
_TRAILER = "<QQQIIQQQ8s"
_SPACE = " \t\n\x0b\x0c\r"


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """``ids`` as ``planes`` planes: 32 of a bit or 4 of a byte; a plane of zeros is empty."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max(initial=0))
    if planes == 4:
        columns = ids.view(np.uint8).reshape(-1, 4)
        return [columns[:, k].tobytes() if top >> (8 * k) else b"" for k in range(4)]
    narrow = ids.astype(np.uint16) if top < 1 << 16 else ids
    out = []
    for k in range(32):
        bits = (narrow >> narrow.dtype.type(k)) & narrow.dtype.type(1) if top >> k else None
        out.append(np.packbits(bits.astype(bool)).tobytes() if bits is not None and bits.any() else b"")
    return out


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    width = 32 // len(parts)
    for k, part in enumerate(parts):
        if part:
            raw = np.frombuffer(part, np.uint8)
            values = raw if width == 8 else np.unpackbits(raw, count=n)
            ids |= values.astype(np.uint32) << np.uint32(k * width)
    return ids


class Writer:
    """One file of ids; ``close`` puts it under its name."""

    def __init__(self, path: str, planes: int = 32, block: int = BLOCK):
        self.path, self.planes, self.block = path, planes, block
        folder, name = os.path.split(path)
        self.draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.out = open(self.draft, "wb")
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.index, self.keys, self.nulls, self.counts = [], [], [], []

    def add(self, keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents ``keys`` with ``counts`` ids each."""
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
        self.counts.append(counts.astype("<u8"))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._chunk(ids[at : at + self.block])
            self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        parts = [self.pack(plane) if plane else b"" for plane in to_planes(ids, self.planes)]
        self.out.write(b"".join(parts))
        self.index.append([len(part) for part in parts])

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the file."""
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        n_docs = sum(map(len, self.keys))
        none = np.empty(0, "<u8")
        about = [np.concatenate(x or [none]) for x in (self.keys, self.counts, self.nulls)]
        about[2] = np.packbits(about[2].astype(bool))
        about = [self.pack(x.tobytes()) for x in about]
        index = np.array(self.index, "<u4").reshape(len(self.index), self.planes)
        trailer = struct.pack(_TRAILER, self.n_ids, n_docs, len(index), self.block, self.planes, *map(len, about), MAGIC)
        self.out.write(b"".join([*about, index.tobytes(), trailer]))
        size = self.out.tell()
        self.out.close()
        os.replace(self.draft, self.path)
        return n_docs, self.n_ids, size


class Reader:
    """Documents and ids of one file; only the chunks asked for are read."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        size = os.fstat(self.file.fileno()).st_size
        trailer = struct.calcsize(_TRAILER)
        if size < trailer:
            raise ValueError(f"{path} is no file of token ids")
        self.file.seek(size - trailer)
        self.n_ids, self.n_docs, chunks, self.block, planes, *about, magic = struct.unpack(_TRAILER, self.file.read(trailer))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        at = size - trailer - 4 * chunks * planes
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(4 * chunks * planes), "<u4").reshape(chunks, planes)
        self.starts = np.concatenate([[0], np.cumsum(self.index.sum(axis=1, dtype=np.int64))])
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.file.seek(at - sum(about))
        keys, counts, nulls = (self.unpack(self.file.read(n)) for n in about)
        self.keys = np.frombuffer(keys, "<i8")
        self.counts = np.frombuffer(counts, "<u8").astype(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(nulls, np.uint8), count=self.n_docs).astype(bool)

    def _chunk(self, k: int) -> np.ndarray:
        self.file.seek(int(self.starts[k]))
        raw, parts, at = self.file.read(int(self.starts[k + 1] - self.starts[k])), [], 0
        for n in self.index[k].tolist():
            parts.append(self.unpack(raw[at : at + n]) if n else b"")
            at += n
        return from_planes(parts, min(self.block, self.n_ids - k * self.block))

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` .. ``last - 1`` of the file."""
        first, last = max(first, 0), min(last, self.n_ids)
        if first >= last:
            return np.empty(0, np.uint32)
        low = first // self.block
        chunks = [self._chunk(k) for k in range(low, (last - 1) // self.block + 1)]
        return np.concatenate(chunks)[first - low * self.block : last - low * self.block]

    def close(self) -> None:
        self.file.close()


#: What the word tokenizer does to a text: its normalizers, and the pattern of what it keeps.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_KEPT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: No match of the pattern holds a letter and then a sign or digit, nor white space.
_CUT = r"([A-Za-z])([\x21-\x40\x5b-\x60\x7b-\x7e])"


def takes_words(path: str) -> bool:
    """Whether the tokenizer file is of the kind whose texts may be cut at white space and after letters."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    cuts = [x for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    return (
        [x["type"] for x in steps] == _NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [(x["pattern"], x["behavior"], x["invert"]) for x in cuts] == [({"Regex": _KEPT}, "Removed", True)]
        and not made["model"].get("dropout")
        and not made.get("post_processor")
    )


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library, without special tokens around them.

    Where the tokenizer takes words one by one (``by_words``), each distinct piece of the texts is encoded
    once: pieces end at white space and between a letter and a sign or digit, where no token goes on.
    Up to ``KNOWN`` pieces stay known from slice to slice; more are encoded again.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the worker is forked, Spark fills the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _flat(self, texts: list[str], at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and how many each has."""
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(texts), at_once):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the table of known ones; unknown ones are encoded."""
        if len(self.known) > KNOWN:
            self._forget()
        # of plain ASCII the tokenizer takes the lower case
        texts = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces).to_pylist()
        get = self.known.get
        places = np.fromiter((get(t, -1) for t in texts), np.int64, len(texts))
        new = list(dict.fromkeys(texts[k] for k in np.flatnonzero(places < 0).tolist()))
        if new:
            ids, lengths = self._flat(new, _WORDS_AT_ONCE)
            self.known.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new))))
            self.table, self.lengths = np.concatenate([self.table, ids]), np.concatenate([self.lengths, lengths])
            for k in np.flatnonzero(places < 0).tolist():
                places[k] = get(texts[k])
        return places

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.replace_substring_regex(texts.cast(pa.large_string()), _CUT, r"\1 \2")
        pieces = pc.ascii_split_whitespace(cut)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        places = self._numbers(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = self.lengths[places].astype(np.int32)
        starts = (np.cumsum(self.lengths) - self.lengths)[places]
        counts = n[codes]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = np.repeat(starts[codes] - ends[:-1], counts)
        at += np.arange(len(at))
        return self.table[at], np.diff(ends[bounds])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and how many each has."""
        if not self.by_words:
            return self._flat(texts.to_pylist(), 100)
        whole = np.zeros(len(texts), bool)
        for token in self.special:  # texts that spell out a special token are not cut
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_pieces(texts)
        parts = [self._flat(texts.filter(pa.array(whole)).to_pylist(), 100), self._by_pieces(texts.filter(pa.array(~whole)))]
        counts = np.empty(len(texts), np.int64)
        counts[whole], counts[~whole] = parts[0][1], parts[1][1]
        ids = np.empty(int(counts.sum()), np.uint32)
        mine = np.repeat(whole, counts)
        ids[mine], ids[~mine] = parts[0][0], parts[1][0]
        return ids, counts


def _pieces(text: str) -> Iterator[str]:
    """A text longer than a slice, cut in front of white space."""
    at = 0
    while at < len(text):
        end = at + SLICE // 4
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of about ``SLICE`` bytes, whole texts."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for low, high, data, _ in text_slices(batch.column("text"), SLICE):
            if texts and size + len(data) > SLICE:
                yield pa.concat_arrays(keys), pa.concat_arrays(texts)
                keys, texts, size = [], [], 0
            keys.append(batch.column("key").slice(low, high - low))
            texts.append(batch.column("text").slice(low, high - low))
            size += len(data)
    if texts:
        yield pa.concat_arrays(keys), pa.concat_arrays(texts)


_WRITTEN = "partition int, sequence int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = 1,
    planes: int = 4,
) -> str:
    """Encode every whole text, append ``end_id`` (none: nothing), write the files; returns their folder.

    ``tokenizer`` is the file's path on all machines. Documents are in ascending ``key`` (an integer),
    null first, equal keys by a hash of the text. A null text is empty; other columns are not read. An
    empty table gives no file. ``planes``: 32 for bit planes, 4 for byte planes.
    """
    spark = docs.sparkSession
    if planes not in (4, 32):
        raise ValueError(f"{planes} planes: 32 bit planes or 4 byte planes")
    folder = folder or new_folder(spark, "token-ids")
    place, by_words = mounted(folder), takes_words(tokenizer)
    os.makedirs(place, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition, sequence, out, files = Encoder(tokenizer, by_words), TaskContext.get().partitionId(), 0, None, []
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def closed() -> tuple:
            return (partition, sequence, os.path.basename(out.path), *out.close())

        for keys, texts in _slices(batches):
            if len(texts) == 1 and texts.nbytes > SLICE and by_words:
                parts = [encode(pa.array([piece]))[0] for piece in _pieces(texts[0].as_py())]
                ids, counts = np.concatenate(parts), np.array([sum(map(len, parts))])
            else:
                ids, counts = encode(texts)
            ids = np.insert(ids, np.repeat(np.cumsum(counts), len(end)), np.tile(end, len(counts)))
            counts = counts + len(end)
            ends = np.cumsum(counts)
            low = 0
            while low < len(counts):
                if out is None:
                    out = Writer(f"{place}/ids-{partition:06d}-{sequence:06d}.planes", planes)
                before = int(ends[low - 1]) if low else 0
                high = min(len(counts), int(np.searchsorted(ends, before + FILE_IDS - out.n_ids)) + 1)
                out.add(keys.slice(low, high - low), counts[low:high], ids[before : int(ends[high - 1])])
                low = high
                if out.n_ids >= FILE_IDS:
                    files.append(closed())
                    sequence, out = sequence + 1, None
        if out is not None:
            files.append(closed())
        names = ["partition", "sequence", "file", "n_docs", "n_ids", "n_bytes"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*files)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    body = whole_text(docs, text)
    # the row's place in its input only deals out rows that are wholly equal
    rows = docs.select(
        docs[key].cast("bigint").alias("key"), body.alias("text"), F.xxhash64(body).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["key", "hash", "row"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-size // RANGE)), *order).sortWithinPartitions(*order).select("key", "text")
    dealt.mapInArrow(write, _WRITTEN).write.parquet(f"{folder}/files")
    return folder


def id_files(spark: SparkSession, folder: str) -> DataFrame:
    """(number, start, file, n_docs, n_ids, n_bytes) of the files in the order of their ids; ``start``
    counts the ids of all files before. One row per ``FILE_IDS`` ids or range."""
    files = spark.read.schema(_WRITTEN).parquet(f"{folder}/files")
    order = Window.orderBy("partition", "sequence")
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(order).alias("number")
    return files.select(number, before.alias("start"), "file", "n_docs", "n_ids", "n_bytes")


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(``key``, start, n_tokens, ids) of every document, read from the files: ids before it, its number of
    ids, and the ids as unsigned 32-bit little-endian integers."""
    place = mounted(folder)
    files = id_files(spark, folder).select("number", "start", "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, name in zip(batch.column("start").to_pylist(), batch.column("file").to_pylist()):
                file = Reader(f"{place}/{name}")
                ends = np.concatenate([[0], np.cumsum(file.counts)])
                low = 0
                while low < file.n_docs:
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] + _READ_BYTES // 4, "right")) - 1)
                    high = min(high, file.n_docs, low + 50_000)
                    raw = file.ids(int(ends[low]), int(ends[high])).astype("<u4").tobytes()
                    cuts = (4 * (ends[low : high + 1] - ends[low])).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
                    kind = pa.binary() if cuts.dtype == np.int32 else pa.large_binary()
                    ids = pa.Array.from_buffers(kind, high - low, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.keys[low:high], pa.int64(), mask=file.nulls[low:high]),
                            pa.array(start + ends[low:high], pa.int64()),
                            pa.array(file.counts[low:high], pa.int64()),
                            ids.cast(pa.binary()),
                        ],
                        ["key", "start", "n_tokens", "ids"],
                    )
                    low = high
                file.close()

    n = max(1, files.count())
    dealt = files.repartitionByRange(n, "number").select("start", "file")  # a task for each file
    found = dealt.mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids binary")
    return found.withColumnRenamed("key", key)


def unpacked(ids: bytes) -> list[int]:
    """The ids of one ``ids`` value."""
    return np.frombuffer(ids, "<u4").tolist()
