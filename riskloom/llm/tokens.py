"""Encoding many texts by encoding each distinct unit of a slice once.

A unit is a stretch of text that a tokenizer treats alike wherever it stands, such as a
word. Units are told apart by a 64-bit hash of their bytes, encoded once, and kept in a store
that lives as long as the Python worker. The store holds plain arrays (a hash, two numbers and
the ids of each unit, about 30 bytes) and is bounded; once full it starts anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from riskloom.llm import text as T

#: Units a worker remembers, and the longest unit it remembers, in bytes.
STORED_UNITS = 1_000_000
STORED_LENGTH = 48


@dataclass
class _Level:
    """Units sorted by hash, and where their ids lie in ``flat``."""

    hashes: np.ndarray
    heads: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` of those held, and their places here."""
        place = np.searchsorted(self.hashes, hashes)
        at = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes)
        return at, place[at]

    def merged(self, other: _Level) -> _Level:
        hashes = np.concatenate([self.hashes, other.hashes])
        order = np.argsort(hashes, kind="stable")
        heads = np.concatenate([self.heads, other.heads + np.int32(len(self.flat))])
        sizes = np.concatenate([self.sizes, other.sizes])
        return _Level(hashes[order], heads[order], sizes[order], np.concatenate([self.flat, other.flat]))


class UnitEncoder:
    """Turns byte ranges of a slice into token ids, one flat array with bounds by range."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]]):
        self.encode = encode
        self.levels: list[_Level] = []

    def _remember(self, new: _Level) -> None:
        """Add a level; levels of like size are merged, so that there are few of them."""
        if sum(len(level.hashes) for level in self.levels) + len(new.hashes) > STORED_UNITS:
            self.levels = []
        while self.levels and len(self.levels[-1].hashes) < 2 * len(new.hashes):
            new = self.levels.pop().merged(new)
        self.levels.append(new)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        units, index, inverse = np.unique(T.range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        sizes, sources = np.full(len(units), -1, np.int64), []
        for level in self.levels:
            open_ = np.flatnonzero(sizes < 0)
            at, place = level.find(units[open_])
            sizes[open_[at]] = level.sizes[place]
            sources.append((open_[at], level.heads[place], level.flat))
        missing = np.flatnonzero(sizes < 0)
        if len(missing):
            raw = data.tobytes()
            low, high = starts[index[missing]], ends[index[missing]]
            found = [np.asarray(ids, np.uint32) for ids in self.encode([raw[a:b] for a, b in zip(low.tolist(), high.tolist())])]
            sizes[missing] = [len(ids) for ids in found]
            heads = np.cumsum(sizes[missing]) - sizes[missing]
            flat = np.concatenate(found)
            sources.append((missing, heads, flat))
            kept = np.flatnonzero(high - low <= STORED_LENGTH)
            if len(kept):
                own = sizes[missing[kept]]
                stored = flat[T.ragged(heads[kept], own)]
                self._remember(_Level(units[missing[kept]], (np.cumsum(own) - own).astype(np.int32), own.astype(np.int32), stored))
        first = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.uint32)
        for at, heads, flat in sources:
            ids[T.ragged(first[at], sizes[at])] = flat[T.ragged(heads.astype(np.int64), sizes[at])]
        bounds = np.concatenate([[0], np.cumsum(sizes[inverse])])
        return ids[T.ragged(first[inverse], sizes[inverse])], bounds
