"""Exact deduplication by recipes of content-defined chunks.

A text's key form is its bytes without ASCII white space. A rolling hash over ``ROLL`` bytes cuts it
into chunks of a few KB, so a chunk depends on its content alone. A chunk's identifier is a digest;
identifiers are used only after one pass has verified, by comparing the contents themselves, that none
of them stands for two contents (else longer digests are drawn). A document is then the ordered list of
its chunks' identifiers, its recipe; grouping compares these short lists and the long texts move once.

Skew: contents are compared by a minimum and a maximum per identifier, combined on the map side, so a
chunk of a third of all documents is one row per task; recipes are grouped the same way, and the rows
go back to their group by a join whose hot keys Spark can split.

Defined cases: a null text counts as empty; texts of white space only are equal to it. Of equal texts the
one with the most code points stays, then the smallest id (a null id comes last); of rows that repeat
both id and text exactly one is marked kept. Extra columns are ignored here and kept by ``drop_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatmod.llm.frames import cut, row_keys
from chatmod.llm.spans import SPACES, U64, frugal, slices, utf8, Bytes

ROLL = 48                                   # bytes that decide on a cut
LEAST, MEAN_BITS, MOST = 1024, 12, 16384    # chunk sizes in bytes: least, mean (as a power of two), most
ID_BYTES = 16


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text, as places in ``data``; an empty text has none."""
    hits = np.zeros(0, np.int64)
    if len(data) > ROLL:
        b = Bytes(data)
        end = np.arange(ROLL, len(data) + 1)
        h = (b.prefix[end] - b.prefix[end - ROLL]) * b.inverse[end - ROLL]
        hits = end[h >> U64(64 - MEAN_BITS) == 0]
    ends = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        mine = hits[np.searchsorted(hits, lo + max(LEAST, ROLL)):np.searchsorted(hits, hi)].tolist()
        at, out = lo, []
        for p in (*mine, hi):
            if p - at < LEAST and p < hi:
                continue
            while p - at > MOST:
                at += MOST
                out.append(at)
            if p > at:
                out.append(p)
                at = p
        ends.append(out)
    return ends


def _key_forms(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, list[list[int]], np.ndarray]]:
    """Slices of a batch: rows lo to hi, key bytes, their offsets, chunk ends, code points of the originals."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        solid = ~SPACES[part]
        key = part[solid]
        key_at = np.concatenate([[0], np.cumsum(solid)])[at]
        points = np.diff(np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[at])
        yield lo, hi, key.tobytes(), key_at, _cuts(key, key_at), points


def _id(content: bytes, size: int) -> bytes:
    return hashlib.blake2b(content, digest_size=size).digest()


def _chunks(size: int):
    @frugal
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, key, at, ends, _ in _key_forms(batch.column(0)):
                seen: dict[bytes, set[bytes]] = {}
                for start, out in zip(at.tolist(), ends):
                    for end in out:
                        content = key[start:end]
                        seen.setdefault(_id(content, size), set()).add(content)
                        start = end
                rows = [(i, c) for i, contents in seen.items() for c in contents]
                yield pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows], pa.binary()),
                                                  "content": pa.array([c for _, c in rows], pa.binary())})

    return chunks


def _recipes(size: int):
    @frugal
    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes] = []
            digest: list[str] = []
            points: list[np.ndarray] = []
            for lo, hi, key, at, ends, n in _key_forms(batch.column("__text")):
                points.append(n)
                for start, stop, out in zip(at[:-1].tolist(), at[1:].tolist(), ends):
                    digest.append(hashlib.sha256(key[start:stop]).hexdigest())
                    bounds = [start, *out]
                    made.append(b"".join(_id(key[a:b], size) for a, b in zip(bounds[:-1], bounds[1:])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("k1"), batch.column("k2"),
                 pa.array(np.concatenate(points) if points else [], pa.int64()), pa.array(digest, pa.string()),
                 pa.array(made, pa.binary())], names=["id", "k1", "k2", "n_points", "text_sha256", "recipe"])

    return recipes


def verified_id_size(docs: DataFrame, text_col: str, size: int = ID_BYTES) -> int:
    """The digest size at which every identifier stands for one chunk content, found by comparing contents."""
    while True:
        chunks = docs.select(text_col).mapInArrow(_chunks(size), "id binary, content binary")
        one = chunks.groupBy("id").agg(F.min("content").alias("a"), F.max("content").alias("b"))
        if one.where(F.col("a") != F.col("b")).isEmpty():
            return size
        if size >= 64:
            raise RuntimeError("different chunks share a 64-byte digest")
        size = min(2 * size, 64)


def _groups(docs: DataFrame, id_col: str, text_col: str, id_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(distinct rows with their number of copies, groups by recipe with the row that stays)."""
    size = verified_id_size(docs, text_col, id_bytes)
    d = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *row_keys(id_col, text_col))
    rows = rows.mapInArrow(_recipes(size), f"id {d}, k1 long, k2 long, n_points long, text_sha256 string, recipe binary")
    rows = cut(rows.groupBy("id", "k1", "k2", "n_points", "text_sha256", "recipe").agg(F.count("*").alias("copies")))
    order = F.struct(-F.col("n_points"), F.col("id").isNull(), F.col("id").alias("keep_id"), F.col("k1").alias("keep_k1"),
                     F.col("k2").alias("keep_k2"))
    groups = rows.groupBy("recipe").agg(F.min(order).alias("best"), F.sum("copies").alias("group_size"))
    return rows, cut(groups.select("recipe", "best.keep_id", "best.keep_k1", "best.keep_k2", "group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = ID_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id column, keep_id, group_size, kept, text_sha256 (of the key form)."""
    rows, groups = _groups(docs, id_col, text_col, id_bytes)
    both = rows.join(groups, "recipe").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    best = (F.col("k1") == F.col("keep_k1")) & (F.col("k2") == F.col("keep_k2")) & (F.col("copy") == 1)
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", best.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = ID_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged."""
    _, groups = _groups(docs, id_col, text_col, id_bytes)
    return semi_once(docs, groups.select(F.col("keep_k1").alias("k1"), F.col("keep_k2").alias("k2")), id_col, text_col)


def semi_once(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose keys (k1, k2) are in ``keys``, one row per key."""
    rows = docs.select("*", *[c.alias(f"__{n}") for c, n in zip(row_keys(id_col, text_col), ("k1", "k2"))])
    keys = keys.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    found = rows.join(keys, ["__k1", "__k2"], "left_semi")
    first = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("__k1"))
    return found.withColumn("__n", first).where("__n = 1").drop("__n", "__k1", "__k2")
