"""Exact substring deduplication by super-k-mers.

A window is ``window`` consecutive words of one document. Every window picks a minimiser: the
``minimizer_words``-word run inside it with the smallest hash. Consecutive windows with the same
minimiser form a super-k-mer and travel as one packed string to the bucket of that minimiser, so
equal windows always meet. A bucket sorts its windows by hash, compares the bytes of equal hashes
and knows exactly which windows occur more than once.

Skew: runs of words that are frequent in the whole corpus (counted first, in a table of fixed size)
are chosen only where a window holds nothing else; such windows lie wholly inside a repeated passage,
so their packed strings are equal, and equal strings of one slice of input travel once. The copies
left behind are known duplicates at once.

Defined cases: a null text has no words; a document shorter than a window keeps every word; rows with
equal id and text both count as occurrences; a null id is an id like any other; extra columns pass
through unchanged. Columns of the input named n_words, n_removed or kept_text are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmod.llm.frames import row_keys
from chatmod.llm.spans import SPACES, U64, frugal, ramp, slices, sliding_min, utf8, Words

WINDOW = 35             # words
MINIMIZER_WORDS = 4
CELL_BITS = 16          # table of minimiser frequencies: 2**16 counts, whatever the input
FREQUENT_SHARE = 8192   # a cell is frequent above 1/8192 of all runs of words (so at most 8192 cells are)
FLUSH_BYTES = 24 << 20  # packed strings a task holds before it sends them
BUCKETS_PER_PARTITION = 16


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - CELL_BITS)).astype(np.int64)


def _runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every run of ``size`` words."""
    i = words.windows(size)
    return i, words.hash(*words.span(i, i + size))


def _count_cells(size: int):
    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], ~SPACES)
                n += np.bincount(_cell(_runs(words, size)[1]), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    return count


def frequent_cells(docs: DataFrame, text: str, size: int) -> list[int]:
    """Cells of the hash space that hold over 1/``FREQUENT_SHARE`` of all runs of ``size`` words of the
    corpus; at most ``FREQUENT_SHARE`` small integers."""
    cells = docs.select(text).mapInArrow(_count_cells(size), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counted = {r.cell: r.n for r in cells.collect()}       # at most 2**CELL_BITS rows
    limit = sum(counted.values()) / FREQUENT_SHARE
    return sorted(c for c, n in counted.items() if n > limit)


class _Buckets:
    """Packed strings of one task by bucket, sent as compressed blobs."""

    FIELDS = (("size", np.int32), ("k1", np.int64), ("k2", np.int64), ("at", np.int32), ("many", np.uint8))

    def __init__(self):
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, bucket, data, start, end, **fields):
        self.parts.append((bucket, data, start, end, fields))
        self.held += int((end - start).sum())

    def flush(self) -> Iterator[tuple[int, bytes]]:
        blobs: dict[int, list[list[bytes]]] = {}
        for bucket, data, start, end, fields in self.parts:
            order = np.argsort(bucket, kind="stable")
            size = end - start + 1                       # each string keeps the space after it
            packed = data[ramp(start[order], size[order])]
            fields = {"size": size, **fields}
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-2))
            byte = np.concatenate([[0], np.cumsum(size[order])])
            columns = [np.ascontiguousarray(fields[name][order].astype(kind)) for name, kind in self.FIELDS]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                blobs.setdefault(int(bucket[order[a]]), []).append(
                    [c[a:b].tobytes() for c in columns] + [packed[byte[a]:byte[b]].tobytes()])
        self.parts, self.held = [], 0
        pack = zstandard.ZstdCompressor(level=6)
        for bucket, parts in blobs.items():
            fields = [b"".join(column) for column in zip(*parts)]
            head = np.array([len(x) for x in fields], np.int64).tobytes()
            yield bucket, pack.compress(head + b"".join(fields))

    @classmethod
    def read(cls, blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        parts: list[list[bytes]] = []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = len(cls.FIELDS) + 1
            ends = np.cumsum(np.concatenate([[8 * n], np.frombuffer(raw[:8 * n], np.int64)])).tolist()
            parts.append([raw[a:b] for a, b in zip(ends[:-1], ends[1:])])
        fields = [b"".join(column) for column in zip(*parts)]
        return ({name: np.frombuffer(x, kind) for (name, kind), x in zip(cls.FIELDS, fields)},
                np.frombuffer(fields[-1], np.uint8))


_OUT = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()),
                  ("from", pa.int32()), ("until", pa.int32())])
_OUT_DDL = "bucket int, blob binary, k1 long, k2 long, `from` int, until int"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(np.unique(np.stack([c.astype(np.int64) for c in columns], axis=1), axis=0).T)


def _pack(window: int, size: int, buckets: int, frequent: list[int]):
    wide = window - size + 1

    def split(words: Words, k1: np.ndarray, k2: np.ndarray):
        run, h = _runs(words, size)
        common = np.zeros(1 << CELL_BITS, bool)
        common[frequent] = True
        rank = (h >> U64(1)) | (common[_cell(h)].astype(U64) << U64(63))    # frequent runs come last
        lengths = np.diff(words.first)
        starts = np.maximum(lengths - window + 1, 0)
        runs = np.maximum(lengths - size + 1, 0)
        run_first = np.cumsum(runs) - runs
        # minima over the concatenated runs; those that start a window lie within one text
        least = sliding_min(rank, wide)[ramp(run_first, starts)]
        at = ramp(words.first[:-1], starts)
        doc = np.repeat(np.arange(len(lengths)), starts)
        if not len(at):
            return None
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        n = np.diff(head, append=len(at))
        return at[head], at[head] + n + window - 1, least[head], doc[head], at[head] - words.first[doc[head]], n

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buckets()

        def send():
            blobs = list(held.flush())
            if blobs:
                yield _rows(bucket=[b for b, _ in blobs], blob=[x for _, x in blobs])

        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], ~SPACES)
                found = split(words, *keys)
                if found is None:
                    continue
                i, j, least, doc, at, n = found
                start, end = words.span(i, j)
                group, first = words.group(start, end)
                many = np.bincount(group, minlength=len(first)) > 1
                k1, k2 = keys[0][lo:hi][doc], keys[1][lo:hi][doc]
                again = many[group]
                if again.any():     # every window of these strings occurs elsewhere in this slice
                    a, b, f, u = _distinct(k1[again], k2[again], at[again], (at + n + window - 1)[again])
                    bucket = np.abs(b) % buckets
                    yield _rows(bucket=bucket, k1=a, k2=b, **{"from": f, "until": u})
                held.add((least[first] % U64(buckets)).astype(np.int64), words.data, start[first], end[first],
                         k1=k1[first], k2=k2[first], at=at[first], many=many)
                if held.held > FLUSH_BYTES:
                    yield from send()
        yield from send()

    return pack


def _count(window: int):
    def count(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.is_null(table["blob"])).select(["k1", "k2", "from", "until"])
        blobs = [b for b in table["blob"].to_pylist() if b is not None]
        if not blobs:
            return known
        record, data = _Buckets.read(blobs)
        words = Words(data, np.array([0, len(data)]), ~SPACES)
        ends = np.cumsum(record["size"])
        first = np.searchsorted(words.start[:-1], np.concatenate([[0], ends[:-1]]))
        n = np.diff(first, append=len(words)) - window + 1
        owner = np.repeat(np.arange(len(n)), n)
        at = ramp(first, n)
        group, rep = words.group(*words.span(at, at + window))
        times = np.bincount(group, weights=1 + record["many"][owner], minlength=len(rep))
        hit = (times[group] > 1) & ~record["many"][owner].astype(bool)
        i = np.flatnonzero(hit)
        if not len(i):
            return known
        head = np.ones(len(i), bool)
        head[1:] = (np.diff(i) != 1) | (owner[i[1:]] != owner[i[:-1]])
        last = np.append(head[1:], True)
        o = owner[i[head]]
        begin = record["at"][o].astype(np.int64) + (at[i[head]] - first[o])
        until = record["at"][o].astype(np.int64) + (at[i[last]] - first[o]) + window
        a, b, f, u = _distinct(record["k1"][o], record["k2"][o], begin, until)
        return pa.concat_tables([known, pa.table({"k1": pa.array(a), "k2": pa.array(b), "from": pa.array(f, pa.int32()),
                                                  "until": pa.array(u, pa.int32())})])

    return count


def _remove(text: str):
    @frugal
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            spans = batch.column("__cut")
            kept: list[bytes] = []
            total, gone = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], ~SPACES)
                change = np.zeros(len(words) + 1, np.int64)
                cut = spans.slice(lo, hi - lo)
                flat = cut.flatten()
                if len(flat):
                    doc = np.repeat(np.arange(hi - lo), np.asarray(cut.value_lengths().fill_null(0)))
                    base = words.first[:-1][doc]
                    np.add.at(change, base + flat.field("from").to_numpy(), 1)
                    np.add.at(change, base + flat.field("until").to_numpy(), -1)
                out = np.cumsum(change[:-1]) > 0
                total[lo:hi] = np.diff(words.first)
                gone[lo:hi] = np.diff(np.concatenate([[0], np.cumsum(out)])[words.first])
                stay = np.flatnonzero(~out)
                size = np.diff(words.start)[stay]
                packed = words.data[ramp(words.start[stay], size)]
                byte = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(stay, words.first)].tolist()
                packed = packed.tobytes()
                kept += [packed[a:max(a, b - 1)] for a, b in zip(byte[:-1], byte[1:])]
            names = [n for n in batch.schema.names if n != "__cut"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(total), pa.array(gone), pa.array(kept, pa.binary()).cast(pa.string())],
                names=names + ["n_words", "n_removed", "kept_text"])

    return remove


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                            minimizer_words: int = MINIMIZER_WORDS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    if not 1 <= minimizer_words <= window:
        raise ValueError("minimizer_words must lie between 1 and window")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_cells(docs, text_col, minimizer_words)
    packed = docs.select(*row_keys(id_col, text_col), text_col).mapInArrow(
        _pack(window, minimizer_words, parts * BUCKETS_PER_PARTITION, frequent), _OUT_DDL)
    spans = packed.groupBy("bucket").applyInArrow(_count(window), "k1 long, k2 long, `from` int, until int")
    cuts = spans.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
        F.collect_set(F.struct("from", "until")).alias("__cut"))
    rows = docs.drop("n_words", "n_removed", "kept_text")
    rows = rows.select("*", *[c.alias(f"__{k}") for c, k in zip(row_keys(id_col, text_col), ("k1", "k2"))])
    joined = rows.join(cuts, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    schema = T.StructType(joined.schema.fields[:-1] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                                                       T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_remove(text_col), schema)
