"""Canonical length-limited Huffman codes over integers, on numpy arrays.

Bits are written from the top of each byte. A canonical code is fixed by its lengths alone, so a code book
stores one length per symbol; the decoding table has one entry per ``limit`` bits.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def code_lengths(weights: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for symbols of weight 0."""
    used = np.flatnonzero(weights)
    out = np.zeros(len(weights), np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(weights[used], kind="stable")
    items = weights[used][order].astype(np.float64)
    packages, coin = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([items, packages])
        rank = np.argsort(both, kind="stable")
        coin.append(rank < n)
        both = both[rank]
        packages = both[0:len(both) // 2 * 2:2] + both[1::2]
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(coin):
        own = int(level[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out[used[order]] = length
    return out


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(self.lengths)
        self.symbols = used[np.argsort(self.lengths[used], kind="stable")]     # by length, then symbol
        size = self.lengths[self.symbols]
        self.limit = int(size.max(initial=1))
        width = U64(1) << (self.limit - size).astype(U64)
        first = np.concatenate([np.zeros(1, U64), np.cumsum(width)])[:-1]
        self.codes = np.zeros(len(self.lengths), U64)
        self.codes[self.symbols] = first >> (self.limit - size).astype(U64)
        self._width, self._table = width.astype(np.int64), None

    def encode(self, symbols: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """(bytes, number of bits, bit offset of every symbol)."""
        return pack(self.codes[symbols], self.lengths[symbols])

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            fill = (1 << self.limit) - int(self._width.sum())
            pad = lambda x: np.concatenate([np.repeat(x, self._width), np.zeros(fill, np.int64)])
            self._table = pad(self.symbols).astype(np.uint32), pad(self.lengths[self.symbols]).astype(np.uint8)
        return self._table

    def decode(self, data: bytes, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
        """``count[i]`` symbols from bit ``offset[i]`` for every i, one after the other. All segments advance
        together: one table look-up per step reads the next symbol of each."""
        symbol, size = self._tables()
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[:len(data)] = np.frombuffer(data, np.uint8)
        eight = np.ndarray(len(data) + 1, ">u8", padded.data, strides=(1,))
        out = np.empty(int(count.sum()), np.uint32)
        order = np.argsort(-count, kind="stable")
        at, to, left = offset[order].astype(np.int64), (np.cumsum(count) - count)[order], count[order]
        mask = U64((1 << self.limit) - 1)
        for step in range(int(left.max(initial=0))):
            live = int(np.searchsorted(-left, -step, "left"))       # segments longer than ``step``
            here = at[:live]
            bits = (eight[here >> 3].astype(U64) >> (64 - self.limit - (here & 7)).astype(U64)) & mask
            out[to[:live] + step] = symbol[bits]
            at[:live] += size[bits]
        return out


def place(values: np.ndarray, lengths: np.ndarray, offset: np.ndarray, words: int) -> np.ndarray:
    """Bit strings (the low ``lengths`` bits of values, 1 to 64 each) at ascending bit offsets of ``words`` big-endian
    words. No two strings share a bit."""
    out = np.zeros(words + 1, U64)
    if len(values):
        word, room = offset >> 6, 64 - (offset & 63)
        over = lengths - room
        fits = over <= 0
        here = np.where(fits, values << np.where(fits, -over, 0).astype(U64), values >> np.where(fits, 0, over).astype(U64))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.add.reduceat(here, starts)
        cut = np.flatnonzero(~fits)
        out[word[cut] + 1] += values[cut] << (64 - over[cut]).astype(U64)
    return out[:words].astype(">u8")


def pack(values: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """Bit strings one after the other: (bytes, number of bits, offset of each string)."""
    offset = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    return place(values, lengths, offset, -(-total // 64)).tobytes()[:-(-total // 8)], total, offset
