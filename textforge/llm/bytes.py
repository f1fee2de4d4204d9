"""Whole texts as byte arrays: slicing of Arrow batches, words, lines, hashes. No Spark in here.

The helpers work on the bytes of many texts laid end to end (``data``) with the offset of every
text (``offsets``, one more than texts). A null text counts as an empty one. All working memory
is proportional to the slice, which is ``SLICE_BYTES`` or one text, whichever is more.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BLOCK = 1 << 15  # elements handled at once where temporary arrays should stay in the cache
WINDOW_WORDS = 5

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text each."""
    for batch in batches:
        data, offsets = text_arrays(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= _K1
    x ^= x >> np.uint64(27)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit value for an ordered pair of them."""
    return mix(left * np.uint64(_BASE) + (right ^ (right >> np.uint64(29))) * _K1 + _K2)


class _Powers:
    """Powers of the hash base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = _INVERSE
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + (BLOCK << 2), "right")), first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _POWERS.upto(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        value = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _K2
        out[first:last] = mix(value)
        first = last
    return out


def words(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each text's words among them."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separator[data], out=inside[1:-1])
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[inside[inner] & inside[inner + 1]]  # two texts that meet without a separator
    starts[both] = True
    ends[both] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines split at \\n (an empty text is one empty line), and line offsets."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per_text)])


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text index of every item, given item offsets per text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def count_in(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many positions are set in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int = WINDOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one text, with the index of its first word."""
    text = owner(offsets)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(text[:n] == text[size - 1 :])
    value = hashes[first]
    for k in range(1, size):
        value = pair(value, hashes[first + k])
    return value, first


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
