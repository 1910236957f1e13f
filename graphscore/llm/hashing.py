"""Vectorised words, word hashes and window hashes over many texts at once (numpy on UTF-8 bytes).

Words are parted by ASCII white space, which UTF-8 never uses inside a character, so bytes give the same words as
code points. A word's hash is XXH3 (128 bits, kept as two halves), taken once for each distinct word of a batch. A window's hash folds
its words' hashes one after the other through a nonlinear step, so equal hashes don't follow from how words repeat or swap
places. Where equality decides alone, both halves are used; nothing here keeps state between calls.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """The words of some texts: ``start`` and ``end`` in ``bytes``, ``first[i]`` the number of words before text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.bytes = _LOWER[raw] if lower else raw
        edge = np.diff(_SPACE[self.bytes].view(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """Two 64-bit hashes by word, as two rows: equal words have equal hashes."""
        n = len(self)
        if not n:
            return np.zeros((2, 0), U)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        flat = self.bytes[~_SPACE[self.bytes]]
        coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        unique = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), ">u8").astype(U).reshape(-1, 2)
        return np.ascontiguousarray(unique[coded.indices.to_numpy()].T)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash by window of ``size`` consecutive words, by start; windows may cross from one text to the next."""
    n = max(0, len(hashes) - size + 1)
    x = hashes[:n].copy()
    for k in range(1, size):
        x ^= x >> U(29)
        x *= U(_P)
        x += hashes[k : k + n]
    return mixed(x)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows inside one text: start, and which text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][text], text


def sets(texts: list[bytes], size: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, where each text's begin, and the shingles' second hashes. A text of fewer than ``size`` words has all of them as its one shingle; one without words has none."""
    ws = Words(texts, lower)
    both, counts = ws.hashes(), ws.counts()
    at, text = window_starts(ws.first, size)
    parts, texts_of = [[windows(h, size)[at] for h in both]], [text]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            parts.append([mixed(windows(h, n)[ws.first[short]] + U(n)) for h in both])
            texts_of.append(short)
    values, more, text = *(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(texts_of)
    order = np.lexsort((values, text))
    values, more, text = values[order], more[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, more, text = values[new], more[new], text[new]
    return values, np.searchsorted(text, np.arange(len(texts) + 1)), more


def rowwise(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple]:
    """Rows of a batch as tuples; only ``size`` of them are Python objects at a time."""
    for k in range(0, batch.num_rows, size):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, size).columns), strict=True)


def batches(rows: Iterable, size_of, limit: int = 2_000_000) -> Iterator[list]:
    """Rows in lists whose sizes add up to ``limit`` or little more, so that memory doesn't follow the Arrow batch."""
    some, total = [], 0
    for row in rows:
        some.append(row)
        total += size_of(row)
        if total >= limit:
            yield some
            some, total = [], 0
    if some:
        yield some


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not the GNU C library
    _trim = None


def released() -> None:
    """Gives freed memory back to the system; for the end of a task, as Python workers outlive it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
