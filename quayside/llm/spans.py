"""Vectorised spans of UTF-8 text inside Arrow batches: words, lines and their hashes.

A batch of texts is one byte buffer with offsets. A prefix sum of byte codes times powers of an odd
multiplier gives the 64-bit hash of every span in it by one subtraction, without a Python loop over words.
A-Z have the codes of a-z, so spans that differ in ASCII case hash alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 19
#: [\x20\x09-\x0D]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: 0-9, A-Z, a-z and every byte of a non-ASCII code point
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = 0x9E3779B97F4A7C15
_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(_ODD)) | U64(1)
_CODES[65:91] = _CODES[97:123]
_BASE = 0xD1342543DE82EF95
_POWERS = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n + 1:
        size = max(2 * n, CHUNK_BYTES) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Chunk:
    """Some whole texts of a batch: ``data``, the texts' ``offsets`` in it and ``first``, the number of the first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets, first
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans of bytes, the same wherever the span stands."""
        n = len(self.data)
        up, down = _powers(n)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(_CODES[self.data] * up[:n], out=self._sums[1:])
        return mix64((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(U64))

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of member bytes within texts, and each text's offset among them."""
        inside = member[self.data]
        n = len(inside)
        begins = self.offsets[:-1]
        begins = begins[begins < n]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[begins] = inside[begins]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        last = self.offsets[1:]
        last = last[last > 0] - 1
        end[last] = inside[last]
        starts = np.flatnonzero(start)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)

    def words(self, member: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and each text's offset among them."""
        starts, ends, at = self.runs(member)
        return self.hashes(starts, ends), at


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts in pieces of about ``limit`` bytes; a longer text is a piece of its own."""
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def owners(at: np.ndarray) -> np.ndarray:
    """For each item, the number of the text that has it."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def shingles(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words within texts, and each text's offset among them.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    which = owners(out_at)
    begin = at[:-1][which] + (np.arange(out_at[-1]) - out_at[:-1][which])
    stop = at[1:][which]
    h = np.zeros(len(begin), dtype=U64)
    for k in range(width):
        place = begin + k
        here = place < stop
        h = h * U64(_BASE) + np.where(here, words[np.where(here, place, 0)] | U64(1), U64(0)) if len(words) else h
    return mix64(h), out_at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and each text's offset among them."""
    v = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        v[a:b].sort()
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    new[at[:-1][at[:-1] < len(v)]] = True
    return v[new], np.concatenate([[0], np.cumsum(new)])[at]
