"""Tokenising whole texts by their distinct chunks.

A chunk is a run of white space and the run of other characters after it. Every tokenizer used here
splits texts by a pattern none of whose matches crosses such a boundary, so a text's ids are its chunks'
ids in order. Distinct chunks of a slice are found by hash and compared byte by byte; their ids are kept in
a table of bounded size per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from chatmod.llm.spans import SPACES, U64, Bytes, equal_spans, ramp, slices

SLICE_BYTES = 2 << 20       # texts that share one look-up in the table
TABLE_ROWS = 3 << 19        # distinct chunks a worker remembers; then it starts over

# UTF-8 of the white space beyond ASCII (Unicode White_Space)
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    mask = SPACES[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        for s in _WIDE_SPACES:
            hit = lead[np.all([padded[lead + k] == b for k, b in enumerate(s)], axis=0)]
            for k in range(len(s)):
                mask[hit + k] = True
    return mask


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start. Texts start one; so does white space after anything else, but for the separators
    0x1C to 0x1F, which not every tokenizer counts as white space."""
    n = len(data)
    start = np.zeros(n, bool)
    if n:
        space = _spaces(data)
        start[1:] = space[1:] & ~space[:-1] & ~((data[:-1] >= 0x1C) & (data[:-1] <= 0x1F))
        start[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(start)


def joinable(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of these chunks, ``size`` bytes each, have white space before and none after: joined they are one text of
    just these chunks. And which have bytes beyond ASCII."""
    end = np.cumsum(size)
    start, last = end - size, end - 1
    space = _spaces(data)
    wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
    return space[start] & ~space[last] & ~((data[last] >= 0x1C) & (data[last] <= 0x1F)), wide[end] > wide[start]


class _Blob:
    """Bytes that only need comparing."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[:len(data)] = data
        self.data = data
        self.eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


class ChunkEncoder:
    """Ids of texts by a function that encodes distinct chunks: all their ids, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], table_rows: int = TABLE_ROWS, slice_bytes: int = SLICE_BYTES):
        self.encode, self.table_rows, self.slice_bytes = encode, table_rows, slice_bytes
        self._clear()

    def _clear(self):
        self.hash = np.zeros(0, U64)
        self.row = np.zeros(0, np.int64)                # of the sorted hashes
        self.at = np.zeros(1, np.int64)                 # rows' bytes in the blob
        self.blob = _Blob(np.zeros(0, np.uint8))
        self.id_at = np.zeros(1, np.int64)              # rows' ids
        self.ids = np.zeros(0, np.uint32)

    def _rows(self, data: Bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The table's row of each of these distinct spans, encoding those it lacks."""
        h, length = data.hash(start, end), end - start
        row = np.full(len(h), -1, np.int64)
        if len(self.hash):
            p = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            r = self.row[p]
            ok = np.flatnonzero((self.hash[p] == h) & (self.at[r + 1] - self.at[r] == length))
            ok = ok[equal_spans(data, start[ok], self.blob, self.at[r[ok]], length[ok])]
            row[ok] = r[ok]
        new = np.flatnonzero(row < 0)
        if len(new):
            raw = data.data.tobytes()
            ids, size = self.encode([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
            row[new] = np.arange(len(new)) + len(self.at) - 1
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(size)])
            self.blob = _Blob(np.concatenate([self.blob.data, data.data[ramp(start[new], length[new])]]))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(length[new])])
            hashes, rows = np.concatenate([self.hash, h[new]]), np.concatenate([self.row, row[new]])
            order = np.argsort(hashes, kind="stable")
            self.hash, self.row = hashes[order], rows[order]
        return row

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per slice of rows: lo, hi, all ids, and the place of each row's first id (one more at the end)."""
        for lo, hi in slices(offsets, self.slice_bytes):
            if len(self.at) > self.table_rows:
                self._clear()
            part, at = Bytes(data[offsets[lo]:offsets[hi]]), offsets[lo:hi + 1] - offsets[lo]
            start = chunk_starts(part.data, at)
            end = np.append(start[1:], len(part.data))[:len(start)]
            group, first = part.group(start, end)
            row = self._rows(part, start[first], end[first])[group]
            n = self.id_at[row + 1] - self.id_at[row]
            ids = self.ids[ramp(self.id_at[row], n)]
            yield lo, hi, ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, at)]
