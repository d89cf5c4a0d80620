"""Hashes of the words of whole texts, computed on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19  # texts hashed together; longer texts are hashed piece by piece
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _U((salt * _ODD + _ODD) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHasher:
    """64-bit hashes of the words of byte strings, optionally with A-Z lower-cased."""

    def __init__(self, lower: bool = True):
        byte = np.arange(256, dtype=np.uint64)
        if lower:
            byte[65:91] += _U(32)
        self.value = mix(byte, 7)
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.power = self.inverse = np.ones(0, dtype=np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.power) < n:
            base = 0xD6E8FEB86659FD93
            size = max(n, 1 << 19)
            for name, b in (("power", base), ("inverse", pow(base, -1, 2**64))):
                steps = np.full(size, _U(b))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of ``data`` (uint8) and the byte where each starts; no word crosses a cut."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        word = ~self.space[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[cuts[(cuts >= 0) & (cuts <= n)]] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        start = np.flatnonzero(word & (~before | edge[:-1]))
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self._tables(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.power[:n])])
        return mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64)), start

    def long_words(self, data: np.ndarray) -> np.ndarray:
        """Word hashes of one text of any length, worked in pieces cut at separators."""
        found, at = [], 0
        while at < len(data):
            to = min(at + BLOCK_BYTES, len(data))
            while to < len(data) and not self.space[data[to]]:
                to += 1
            found.append(self.words(data[at:to], np.zeros(0, dtype=np.int64))[0])
            at = to
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts of about ``size`` bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def texts_words(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: first text, end text, word hashes and where each text's words begin among them."""
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > BLOCK_BYTES:
            hashes = hasher.long_words(part)
            yield i, j, hashes, np.array([0, len(hashes)])
            continue
        cuts = offsets[i : j + 1] - offsets[i]
        hashes, start = hasher.words(part, cuts)
        yield i, j, hashes, np.searchsorted(start, cuts)
