"""Benchmark decontamination by a broadcast set of n-gram hashes.

Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case. The windows of
the benchmark items (``window`` words; a shorter item is one window) become a sorted array of hashes,
broadcast to the tasks. Tasks hash the windows of each text, look them up, and compare the bytes of every
hit with the item's window. With one block no row is shuffled.

The benchmark is broadcast in blocks of at most ``block_bytes`` of text (an item is never split). With several
blocks the texts are scanned once for each: a block is read, broadcast, its hits are written to the shared folder
by the digest of their text, and it is released before the next is read; then the texts are joined with all hits.

Defined cases: null texts and items have no words and match nothing; items without an id are listed as
"null"; an id that repeats in the benchmark is listed once; rows of ``docs`` that repeat are judged alike.
Extra columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmod.llm.spans import LOWER, U64, at_task_end, equal_spans, frugal, ramp, slices, utf8, Words
from chatmod.session import shared_dir

WINDOW = 10
BLOCK_BYTES = 8 << 20
FILTER_BITS = 20

WORD = np.ones(256, bool)                   # of the bytes after lower-casing
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                       T.StructField("items", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())])


class _Windows:
    """The distinct windows of one size of a block of items, and the items that hold them."""

    def __init__(self, words: Words, at: np.ndarray, size: np.ndarray, item: np.ndarray):
        start, end = words.span(at, at + size)
        group, rep = words.group(start, end)
        self.words, self.start, self.length = words, start[rep], (end - start)[rep]
        pairs = np.unique(np.stack([group, item], axis=1), axis=0)
        self.item = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(rep) + 1))
        h = words.hash(self.start, self.start + self.length)
        self.order = np.argsort(h, kind="stable")
        self.hash = h[self.order]
        self.most = int(np.unique(self.hash, return_counts=True)[1].max(initial=0))   # windows under one hash
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(h >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, words: Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``at``, window) of every run of ``size`` words at ``at`` that is one of the windows."""
        start, end = words.span(at, at + size)
        h = words.hash(start, end)
        maybe = np.flatnonzero(self.bits[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.searchsorted(self.hash, h[maybe])
        found = []
        for k in range(self.most):
            p = np.minimum(place + k, len(self.hash) - 1)
            i, w = maybe, self.order[p]
            ok = (self.hash[p] == h[i]) & (place + k < len(self.hash)) & (self.length[w] == (end - start)[i])
            i, w = i[ok], w[ok]
            ok = equal_spans(words, start[i], self.words, self.start[w], self.length[w])
            found.append(np.stack([i[ok], w[ok]]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]


_BUILT: dict[str, tuple[list[str], dict[int, _Windows]]] = {}    # the last block of this worker's task
at_task_end(_BUILT.clear)


def _block(shared, window: int) -> tuple[list[str], dict[int, _Windows]]:
    """Names and windows by size of a broadcast block; built once per task."""
    key, names, texts = shared.value
    key = f"{key}/{window}"
    if key not in _BUILT:
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        words = Words(LOWER[data], offsets, WORD)
        count = np.diff(words.first)
        size = np.minimum(count, window)
        n = np.where(count > 0, count - size + 1, 0)
        at, item = ramp(words.first[:-1], n), np.repeat(np.arange(len(texts)), n)
        sizes = size[item]
        windows = {int(k): _Windows(words, at[sizes == k], sizes[sizes == k], item[sizes == k]) for k in np.unique(sizes)}
        _BUILT.clear()
        _BUILT[key] = (names, windows)
    return _BUILT[key]


def _scan(shared, window: int, text: str):
    """Adds the hit ranges of words (as flat from/until pairs) and items of one block to each row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, windows = _block(shared, window)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            hits: list[np.ndarray] = []
            items: list[np.ndarray] = []
            for lo, hi in slices(offsets):
                words = Words(LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo], WORD)
                for size, set_ in windows.items():
                    at = words.windows(size)
                    i, w = set_.find(words, at, size)
                    doc = np.searchsorted(words.first, at[i], "right") - 1
                    begin = at[i] - words.first[doc]
                    hits.append(np.stack([doc + lo, begin, begin + size], axis=1))
                    n = set_.item_at[w + 1] - set_.item_at[w]
                    items.append(np.unique(np.stack([np.repeat(doc + lo, n), set_.item[ramp(set_.item_at[w], n)]], axis=1), axis=0))
            hit = np.unique(np.concatenate(hits or [np.zeros((0, 3), np.int64)]), axis=0)
            item = np.unique(np.concatenate(items or [np.zeros((0, 2), np.int64)]), axis=0)
            old_hit, old_item = batch.column("__hit").to_pylist(), batch.column("__item").to_pylist()
            for doc in np.unique(hit[:, 0]).tolist():
                a, b = np.searchsorted(hit[:, 0], [doc, doc + 1])
                old_hit[doc] = (old_hit[doc] or []) + hit[a:b, 1:].ravel().tolist()
                a, b = np.searchsorted(item[:, 0], [doc, doc + 1])
                old_item[doc] = sorted({*(old_item[doc] or []), *(names[k] for k in item[a:b, 1].tolist())})
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in batch.schema.names if n not in ("__hit", "__item")]
                + [pa.array(old_hit, pa.list_(pa.int32())), pa.array(old_item, pa.list_(pa.string()))], schema=batch.schema)

    return scan


def _finish(text: str, clean: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            ranges, texts = batch.column("__hit").to_pylist(), batch.column(text)
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            cleaned = texts.to_pylist() if clean else [None] * batch.num_rows
            for lo, hi in slices(offsets):
                part = data[offsets[lo]:offsets[hi]]
                words = Words(LOWER[part], offsets[lo:hi + 1] - offsets[lo], WORD)
                n_words[lo:hi] = np.diff(words.first)
                for doc in range(lo, hi):
                    if not ranges[doc]:
                        continue
                    first = words.first[doc - lo]
                    change = np.zeros(n_words[doc] + 1, np.int64)
                    np.add.at(change, np.array(ranges[doc][::2]), 1)
                    np.add.at(change, np.array(ranges[doc][1::2]), -1)
                    hit = np.cumsum(change[:-1]) > 0
                    n_hit[doc] = hit.sum()
                    if clean:
                        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                        keep, at = [], int(offsets[doc] - offsets[lo])
                        for a, b in edge.tolist():
                            keep.append(part[at:words.begin[first + a]].tobytes())
                            at = int(words.end[first + b - 1])
                        keep.append(part[at:offsets[doc + 1] - offsets[lo]].tobytes())
                        cleaned[doc] = b"".join(keep).decode("utf-8")
            names = [n for n in batch.schema.names if n not in ("__hit", "__item")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(n_words), pa.array(n_hit), batch.column("__item").fill_null([]),
                                                    pa.array(cleaned, pa.string())], names=names + RESULT.fieldNames())

    return finish


def _n_blocks(items: DataFrame, text_col: str, block_bytes: int) -> int:
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return -(-2 * size // block_bytes) if size > block_bytes else 1     # half full on average


def _blocks(items: DataFrame, id_col: str, text_col: str, n: int):
    """``n`` blocks (key, ids, texts), each read when it is asked for."""
    spark = items.sparkSession
    rows = items.where(F.length(text_col) > 0).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"),
                                                      F.col(text_col).alias("t"))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct().collect() if n > 1 else rows.distinct().collect()
        part = sorted((r.i, r.t) for r in part)
        yield spark.sparkContext.broadcast((f"{id(part)}/{b}/{hash(tuple(part))}", [i for i, _ in part], [t for _, t in part]))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids) and clean_text (the text without the hit words and
    what stands between them; null unless ``clean``)."""
    rows = docs.drop(*RESULT.fieldNames())
    nothing = [F.lit(None).cast("array<int>").alias("__hit"), F.lit(None).cast("array<string>").alias("__item")]
    n = _n_blocks(benchmark, item_text, block_bytes)
    blocks = _blocks(benchmark, item_id, item_text, n)
    finish = _finish(text_col, clean)
    if n == 1:
        rows = rows.select("*", *nothing)
        scan = _scan(next(blocks), window, text_col)
        judge = lambda batches: finish(scan(batches))
    else:
        folder = shared_dir(docs.sparkSession, f"benchmark-hits-{uuid.uuid4().hex}")
        texts = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"), *nothing)
        for shared in blocks:
            found = texts.mapInArrow(frugal(_scan(shared, window, "text")), texts.schema).where("__hit IS NOT NULL")
            found.select(F.sha2("text", 256).alias("__text"), "__hit", "__item").write.mode("append").parquet(folder)
            shared.destroy()
        hits = docs.sparkSession.read.parquet(folder).groupBy("__text").agg(        # equal texts have equal hits, once per block
            F.flatten(F.collect_set("__hit")).alias("__hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__item")))).alias("__item"))
        rows = rows.withColumn("__text", F.sha2(text_col, 256)).join(hits, "__text", "left").drop("__text")
        judge = finish
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("__hit", "__item")] + RESULT.fields)
    return rows.mapInArrow(frugal(judge), schema)


def contaminated() -> Column:
    return F.col("n_hit") > 0


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    return find_benchmark(docs, benchmark, clean=False, **options).where(~contaminated()).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the words of benchmark windows cut out of the text."""
    found = find_benchmark(docs, benchmark, text_col=text_col, **options).withColumn(text_col, F.col("clean_text"))
    return found.select(*docs.columns)
