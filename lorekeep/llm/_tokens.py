"""Vectorised words and word hashes over Arrow string arrays, a slice of texts at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  # bytes of text worked on at once; one longer text makes a slice of its own
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])  # of the words of letters and digits; all that isn't ASCII is one
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    if n > SLICE + 1:  # keep only the usual size
        _powers[base] = have[: SLICE + 1].copy()
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits each, the last with its high bit off; and where each number starts."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[has] + k] = (values[has] >> 7 * k & 127) | (size[has] > k + 1).astype(np.int64) << 7
    return out, start


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, start)


class Words:
    """Words of a slice of texts: data (lowered bytes), start and end of each word, and first[i]:first[i+1], the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray = _WORD):
        self.data = LOWER[data]
        is_word = of_word[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = is_word[:-1]
        self.start = np.flatnonzero(is_word & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = is_word[1:]
        self.end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, worked out for about SLICE bytes at once, however long a text is."""
        out, a = np.empty(len(self.start), np.uint64), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + SLICE, side="right")))
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            total = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data[lo:hi]] * _power(_BASE, hi - lo), out=total[1:])
            start, end = self.start[a:b] - lo, self.end[a:b] - lo
            out[a:b] = mix((total[end] - total[start]) * _power(_BACK, hi - lo + 1)[start])
            a = b
        return out


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE, of_word: np.ndarray = _WORD) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of each slice of a string array; of_word says which bytes words are made of."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b, Words(data[off[a] : off[b]], off[a : b + 1] - off[a], of_word)
        a = b
    pa.default_memory_pool().release_unused()  # what earlier batches took goes back to the system
