"""Words of many texts at once, as numpy arrays over the bytes that Arrow holds.

All functions work on one slice of a column at a time. A slice holds at most
``SLICE_BYTES`` bytes unless a single text is longer than that, so what a task
keeps in memory follows the longest text, never the number of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Intermediate arrays take eight bytes and more for each of these.
SLICE_BYTES = 1 << 19
#: The six bytes that separate words: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240521).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def give_back() -> None:
    """Return freed memory to the system: a Python worker or driver lives on after the work is done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Slice:
    """Texts ``first`` to ``last`` of a batch: their bytes and, for n texts, n + 1 offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner_of(self, positions: np.ndarray) -> np.ndarray:
        """The text, counted in this slice, that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def slices(column: pa.Array) -> Iterator[Slice]:
    """Cut a string column into slices; a null text counts as empty.

    After the last one the memory that work on the slices has freed is given back.
    """
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        low, high = int(offsets[first]), int(offsets[last])
        yield Slice(first, last, data[low:high], offsets[first : last + 1] - low)
        first = last
    give_back()


@dataclass
class Words:
    """Byte ranges of words in a slice, the text of each and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    owners: np.ndarray
    bounds: np.ndarray  # words bounds[i]:bounds[i + 1] belong to text i

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def split_words(part: Slice, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not spaces; a text's end also ends a word."""
    inside = ~space[part.data]
    edge = np.zeros(len(part.data) + 1, bool)
    edge[part.offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    owners = part.owner_of(starts)
    return Words(starts, ends, owners, np.searchsorted(owners, np.arange(len(part) + 1)))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one running sum over the bytes."""
    powers, inverses = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the first word of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * np.uint64(_MULTIPLIER) + hashes[k : n + k]
    fits = np.ones(n, bool)
    for stop in np.unique(bounds[1:-1]):
        fits[max(0, stop - size + 1) : stop] = False
    first = np.flatnonzero(fits)
    return mix(total[first]), first


def per_text(values: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``positions``; empty ranges give 0."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[positions[1:]] - sums[positions[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    filled = lengths > 0
    starts, lengths = starts[filled], lengths[filled]
    steps = np.ones(total, np.int64)
    heads = np.cumsum(lengths)[:-1]
    steps[0] = starts[0]
    steps[heads] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(steps)
