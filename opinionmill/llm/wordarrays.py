"""Whole texts as flat numpy arrays: word bounds, lines and 64-bit word hashes.

Helpers for code inside ``mapInArrow`` tasks. Words are ``[^\\x20\\x09-\\x0D]+``
on UTF-8 bytes, which is the same as on code points because the separators are
ASCII. A batch is cut at row bounds into chunks of about ``CHUNK_BYTES``, so the
arrays of one chunk stay small; a single longer text is one chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed 64-bit values of one seed."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * step)


_BYTE = stream(256, 1)
_PLACE = stream(4096, 2) | np.uint64(1)


@dataclass
class Chunk:
    """Rows ``first`` … ``first + rows`` of a batch."""

    first: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, rows + 1 offsets into data
    folded: bool

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end byte of each word; row bounds end words."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = ~_SPACE[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.bounds] = True
        head = word.copy()
        head[1:] &= ~word[:-1] | cut[1:n]
        tail = word.copy()
        tail[:-1] &= ~word[1:] | cut[1:n]
        return np.flatnonzero(head), np.flatnonzero(tail) + 1

    def word_bounds(self, starts: np.ndarray) -> np.ndarray:
        """For each row the first of its words; one more entry at the end."""
        return np.searchsorted(starts, self.bounds, side="left")

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit multilinear hash of each span of bytes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        size = ends - starts
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        data = self.data[place + np.repeat(starts, size)]
        longest = int(size.max())
        table = _PLACE if longest <= len(_PLACE) else stream(longest, 2) | np.uint64(1)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(_BYTE[data] * table[place], first)
            return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def binary(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def chunks(column: pa.Array, fold: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column of texts (null: empty); ``fold`` lower-cases A-Z."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        part = data[offsets[first]: offsets[last]]
        yield Chunk(first, _LOWER[part] if fold else part,
                    offsets[first: last + 1] - offsets[first], fold)
        first = last


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int, seed: int = 3
            ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words inside each row, and row bounds.

    A row with fewer words (but some) gives one hash of its whole sequence.
    """
    keys = stream(width + 1, seed) | np.uint64(1)
    count = np.diff(bounds)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), out_bounds
    place = np.repeat(bounds[:-1] - out_bounds[:-1], made) + np.arange(total)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    length = np.repeat(np.minimum(count, width), made)
    with np.errstate(over="ignore"):
        acc = length.astype(np.uint64) * keys[width]
        for j in range(width):
            part = padded[place + j] * keys[j]
            acc += np.where(length > j, part, np.uint64(0))
        return mix(acc), out_bounds
