"""NumPy helpers for work inside tasks: Arrow slices, word hashes, segments.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D).
As these bytes never occur inside a multi-byte UTF-8 character, splitting bytes
and splitting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text worked on at once. Byte-level arrays take eight times as much each.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that changes about half of the bits for each bit changed."""
    x = x.astype(np.uint64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(n, dtype=np.uint64) + _U(seed * 1_000_003 + 17)) | _U(1)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, row offsets)`` for runs of rows of about ``limit`` bytes.

    A null is an empty text. A longer text is a run of its own.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    rows = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, rows + 1, column.offset * 8) if rows else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of the rows' words among them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; worked out in pieces, so that long texts need little memory."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + SLICE_BYTES, "right")))
        own = lengths[first:last]
        begin = np.cumsum(own) - own
        within = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(begin, own)
        letters = data[within + np.repeat(starts[first:last], own)]
        if lower:
            letters = _LOWER[letters]
        powers = np.full(int(own.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        values = _BYTE_VALUES[letters] * powers[within]
        out[first:last] = mix(np.add.reduceat(values, begin) + own.astype(np.uint64))
        first = last
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of ``size`` values; shorter input has none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, factor in enumerate(odd_numbers(size, seed)):
        out += words[j : j + n] * factor
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(begin - starts, lengths)
