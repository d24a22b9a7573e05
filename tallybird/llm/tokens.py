"""Words of Arrow string columns as numpy hash arrays, without a Python loop over words.

A column is worked on in slices of whole texts of a few MB, so memory follows the longest text and
not the batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (a multiply-xorshift finaliser)."""
    x = np.array(x, np.uint64)  # a copy, worked on in place
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    start = np.uint64(seed * 0xD1342543DE82EF95 & _MASK)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + start)


# Classes of bytes. White space is \x20 and \x09-\x0D; bytes from 0x80 belong to letters.
_codes = np.arange(256)
_space = (_codes == 0x20) | ((_codes >= 9) & (_codes <= 13))
_letter = (_codes >= 0x80) | np.isin(_codes, [ord(c) for c in "_0123456789"])
_letter |= np.isin(_codes & 0xDF, np.arange(65, 91)) & (_codes < 0x80)
#: Words are runs of anything but white space.
WORDS = np.where(_space, 0, 1).astype(np.uint8)
#: 1: runs of letters and digits, 2: runs of signs.
PIECES = np.where(_space, 0, np.where(_letter, 1, 2)).astype(np.uint8)
#: Runs of letters and digits alone; signs separate like white space.
LETTERS = np.where(_letter, 1, 0).astype(np.uint8)
CASED = random_words(256, 11)
LOWER = CASED.copy()
LOWER[65:91] = CASED[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


class Tokens(NamedTuple):
    hashes: np.ndarray  # uint64, one per token
    start: np.ndarray  # byte positions in the slice
    end: np.ndarray
    kind: np.ndarray  # class of the token
    bounds: np.ndarray  # tokens of text i: bounds[i] .. bounds[i+1]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, UTF-8 bytes, byte offsets from 0) for runs of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def tokenise(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS, table: np.ndarray = CASED
) -> Tokens:
    """Maximal runs of one byte class (0 separates) that do not cross texts, each hashed."""
    none = np.empty(0, np.int64)
    if len(data) == 0:
        return Tokens(none.astype(np.uint64), none, none, none.astype(np.uint8), np.zeros(len(offsets), np.int64))
    kind = classes[data]
    border = np.empty(len(data), bool)
    border[0] = True
    np.not_equal(kind[1:], kind[:-1], out=border[1:])
    inner = offsets[:-1]
    border[inner[inner < len(data)]] = True
    start = np.flatnonzero(border)
    end = np.append(start[1:], len(data))
    values = table[data]
    values *= powers(_BASE, len(data))
    hashes = np.add.reduceat(values, start)
    hashes *= powers(_INVERSE, len(data))[start]
    real = kind[start] > 0
    start, end, hashes = start[real], end[real], hashes[real]
    return Tokens(mix(hashes), start, end, kind[start], np.searchsorted(start, offsets))


def grams(tokens: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` tokens and their bounds by text. A text of 1 to ``n - 1`` tokens
    has one gram of all its tokens, an empty text none."""
    lengths = np.diff(bounds)
    kept = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
    total = int(out[-1])
    if total == 0:
        return np.empty(0, np.uint64), out
    first = np.repeat(bounds[:-1] - out[:-1], kept) + np.arange(total)
    last = np.repeat(bounds[1:], kept)  # grams of short texts end with them
    made = np.zeros(total, np.uint64)
    # a random term stands for each missing place, so a short text is none of the longer ones
    for k, (factor, missing) in enumerate(zip(random_words(n, 23) | np.uint64(1), random_words(n, 29))):
        at = first + k
        inside = at < last
        made += np.where(inside, tokens[np.where(inside, at, 0)] * factor, missing)
    return mix(made), out
