"""Byte-level helpers for whole Arrow batches of text (numpy, no Python string per word).

A batch's texts stay one UTF-8 buffer. Words are spans of that buffer; a span's 64-bit
hash comes from prefix sums, so the hash of any run of words costs one subtraction.
Hashes only group candidates: ``equal_spans`` and ``group_spans`` compare the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, U64), np.ones(1, U64)]   # powers of the radix and of its inverse, grown on demand

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_AT_TASK_END: list = []


def at_task_end(forget):
    """Registers a function that drops tables a module keeps in its worker."""
    _AT_TASK_END.append(forget)
    return forget


def release() -> None:
    for forget in _AT_TASK_END:
        forget()


@at_task_end
def _forget_powers() -> None:
    _POWERS[:] = [np.ones(1, U64), np.ones(1, U64)]


def frugal(task):
    """A function over Arrow batches that drops what its worker's modules keep and gives free memory back when it
    ends: workers outlive tasks, and several of them share an executor's memory."""
    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):         # only the GNU C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = -(-n // (1 << 20)) << 20
        for i, r in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            p = np.full(size, U64(r))
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def equal_spans(x: Bytes, a: np.ndarray, y: Bytes, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of ``length`` bytes at ``a`` in x and at ``b`` in y hold the same bytes."""
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    at = 0
    while True:
        live = live[length[live] >= at + 8]
        if not len(live):
            break
        hit = x.eight[a[live] + at] != y.eight[b[live] + at]
        same[live[hit]] = False
        live = live[~hit]
        at += 8
    rest = (length & 7).astype(U64)
    tail = length - (length & 7)
    mask = (U64(1) << (rest * U64(8))) - U64(1)
    return same & ((x.eight[a + tail] ^ y.eight[b + tail]) & mask == 0)


class Bytes:
    """A buffer with O(1) span hashes and unaligned eight-byte reads."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        power, self.inverse = _powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        terms = self.prefix[1:]
        terms[:] = data
        terms += U64(1)
        terms *= power[:n]
        np.cumsum(terms, out=terms)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = data
        self.eight = np.ndarray(n + 1, "<u8", padded.data, strides=(1,))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return equal_spans(self, a, self, b, length)

    def group(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each span, first span of each group): two spans share a group exactly if
        their bytes are equal. Sorting by hash brings candidates together, the bytes decide."""
        n = len(start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self.hash(start, end)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        new = np.ones(n, bool)
        new[1:] = hs[1:] != hs[:-1]
        run = np.cumsum(new) - 1
        first = order[new]
        group = np.empty(n, np.int64)
        group[order] = run
        rep = first[group]
        length = end - start
        other = np.flatnonzero(rep != np.arange(n))
        bad = length[other] != length[rep[other]]
        ok = other[~bad]
        bad[~bad] = ~self.equal(start[ok], start[rep[ok]], length[ok])
        if bad.any():                       # different bytes under one hash: groups of their own
            seen: dict[tuple[int, bytes], int] = {}
            extra = []
            for i in other[bad].tolist():
                key = (int(group[i]), self.data[start[i]:end[i]].tobytes())
                if key not in seen:
                    seen[key] = len(first) + len(extra)
                    extra.append(i)
                group[i] = seen[key]
            first = np.concatenate([first, np.array(extra, np.int64)])
        return group, first


class Words(Bytes):
    """The words of some texts, one space after each, in one buffer.

    ``start[i]:start[j] - 1`` are words i to j - 1 joined by one space; ``first[d]`` is the
    first word of text d (``first[-1]``: all words). ``is_word`` tells which bytes words are made of;
    ``begin`` and ``end`` are the words' places in the input. Without ``hashed`` spans have no hashes, which take
    most of the memory.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        w = is_word[data]
        n = len(data)
        edge = offsets[:-1][offsets[:-1] < n]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        if n:
            before[0] = after[-1] = False
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        self.begin = begin = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        size = self.end - begin
        self.start = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(size + 1, out=self.start[1:])
        out = np.full(self.start[-1], 0x20, np.uint8)
        letter = np.ones(len(out), bool)
        letter[self.start[1:] - 1] = False
        out[letter] = data[w]
        self.first = np.searchsorted(begin, offsets)
        if hashed:
            super().__init__(out)
        else:
            self.data = out

    def __len__(self) -> int:
        return len(self.start) - 1

    def span(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.start[i], self.start[j] - 1

    def windows(self, size: int) -> np.ndarray:
        """The first words of all runs of ``size`` words that lie within one text."""
        count = np.maximum(np.diff(self.first) - size + 1, 0)
        return ramp(self.first[:-1], count)


def ramp(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … (count[0] numbers), start[1], …"""
    total = int(count.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else start, count)
    return np.arange(total, dtype=np.int64) + shift


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])
