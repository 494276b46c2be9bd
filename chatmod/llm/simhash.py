"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within ``radius`` bits agree in some of any ``radius + 2`` blocks of bits taken two at a
time, so every fingerprint goes to one bucket per pair of blocks. A bucket stores its fingerprints as 64
bit planes. One shift of the planes lines every fingerprint up with its d-th neighbour; XOR gives one bit of
all those distances at once, carry-save counters add it to them, and the shift is abandoned once every
distance exceeds the radius. Linked fingerprints become star edges; their components are Spark joins.

Skew: equal fingerprints are one fingerprint before any bucket is made. A bucket of more than
``bucket_rows`` distinct fingerprints is not compared in one task: its fingerprints go to the keys of all
fingerprints up to radius / 2 bits away, where any two within the radius meet in a group of bounded size.

Defined cases: a text without words (null too) has fingerprint 0 and is linked like any other; fewer words
than a shingle are one shingle; component_id is the smallest id reachable (null ids last). Extra columns
are ignored here and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmod.llm.components import connected_components
from chatmod.llm.exact_dedup import semi_once
from chatmod.llm.frames import cut, row_keys
from chatmod.llm.spans import LOWER, SPACES, U64, frugal, slices, utf8, Words

SHINGLE, RADIUS, SEED = 3, 2, 42
BUCKET_ROWS = 2048          # distinct fingerprints compared in one bucket
BLOCK = 1 << 13             # shingles whose bits are added up at a time
SLICE_BYTES = 1 << 20       # texts at a time; a longer text takes some 12 bytes of memory per byte


def fingerprints(words: Words, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of every text of ``words``."""
    count = np.diff(words.first)
    at = words.windows(shingle)
    start, end = words.span(at, at + shingle)
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):              # the whole sequence is the one shingle
        s, e = words.span(words.first[short], words.first[short + 1])
        start, end = np.concatenate([start, s]), np.concatenate([end, e])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    text, digest = memoryview(words.data), xxhash.xxh64_intdigest
    ones = np.zeros((len(n), 64), np.int32)
    owner = np.repeat(np.arange(len(n)), n)
    for lo in range(0, len(start), BLOCK):
        s, e, own = start[lo:lo + BLOCK], end[lo:lo + BLOCK], owner[lo:lo + BLOCK]
        h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(s.tolist(), e.tolist())), U64, len(s))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(U64).ravel()


def _fingerprint(shingle: int):
    @frugal
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            out = [np.zeros(0, U64)]
            for lo, hi in slices(offsets, SLICE_BYTES):
                words = Words(LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo], ~SPACES, hashed=False)
                out.append(fingerprints(words, shingle))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"),
                                              pa.array(np.concatenate(out).view(np.int64))], names=["id", "k1", "k2", "fp"])

    return fingerprint


def _planes(bits: np.ndarray) -> list[int]:
    """Columns of a 0/1 matrix as integers: bit i of plane b is bits[i, b]."""
    return [int.from_bytes(np.packbits(column, bitorder="little").tobytes(), "little") for column in bits.T]


def near_pairs(fps: np.ndarray, room: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j <= i + room[i], of fingerprints at most ``radius`` bits apart, bit-sliced."""
    planes = _planes(np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    width = radius.bit_length()
    left, right = [], []
    for d in range(1, int(room.max(initial=0)) + 1):
        live = int.from_bytes(np.packbits(room >= d, bitorder="little").tobytes(), "little")
        counter = [0] * width
        for plane in planes:
            carry = (plane ^ (plane >> d)) & live
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
                if not carry:
                    break
            else:
                live &= ~carry                     # the counter overflowed
            over, even = 0, live                   # counter > radius
            for k in range(width - 1, -1, -1):
                if radius >> k & 1:
                    even &= counter[k]
                else:
                    over, even = over | even & counter[k], even & ~counter[k]
            live &= ~over
            if not live:
                break
        if live:
            i = np.flatnonzero(np.unpackbits(np.frombuffer(live.to_bytes(-(-len(fps) // 8), "little"), np.uint8),
                                             count=len(fps), bitorder="little"))
            left.append(i)
            right.append(i + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n items linked by pairs (i, j)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == old).all():
            return label


def _link(radius: int):
    @frugal
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(key: np.ndarray, fp: np.ndarray):
            head = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            size = np.diff(head, append=len(key))
            level = np.repeat(np.ceil(np.log2(size) / 2).astype(int), size)      # buckets of like size together
            room = np.repeat(head + size, size) - np.arange(len(key)) - 1
            for k in range(1, int(level.max()) + 1):
                rows = np.flatnonzero(level == k)
                if not len(rows):
                    continue
                i, j = near_pairs(fp[rows].view(U64), room[rows], radius)
                if len(i):
                    own = fp[rows]
                    root = own[_stars(len(rows), i, j)]
                    off = root != own
                    yield pa.RecordBatch.from_pydict({"a": pa.array(own[off]), "b": pa.array(root[off])})

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:           # sorted by key; the last bucket may go on in the next batch
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if done >= 8192:
                yield from edges(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
        if len(key):
            yield from edges(key, fp)

    return link


def _bucket_keys(radius: int):
    """One key per pair of ``radius + 2`` blocks of bits: the pair's number and the bits of both blocks."""
    n = radius + 2
    bounds = [64 * i // n for i in range(n + 1)]
    keys = []
    for number, pair in enumerate(combinations(range(n), 2)):
        mask = sum(((1 << bounds[i + 1]) - (1 << bounds[i])) for i in pair)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def _flips(bits: int):
    """All fingerprints that differ from fp in at most ``bits`` places."""
    masks = [sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(64), k)]
    return F.array(*[F.col("fp").bitwiseXOR(F.lit(m - ((m >> 63) << 64))) for m in masks])


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all distinct ``fps`` (fp) at most ``radius`` bits apart."""
    keyed = fps.select("fp", F.explode(_bucket_keys(radius)).alias("key"))
    large = cut(keyed.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"))
    crowded = not large.isEmpty()
    small = keyed.join(large, "key", "left_anti") if crowded else keyed
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = small.repartition(parts, "key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_link(radius), "a long, b long")
    if crowded:
        # two fingerprints within an even radius share a point at most radius / 2 bits from both, and all that share one are linked
        near = keyed.join(large, "key", "left_semi").select("fp").distinct().select("fp", F.explode(_flips(radius // 2)).alias("at"))
        balls = near.groupBy("at").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        pairs = balls.select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
        edges = edges.union(pairs.where("a <> b"))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: the id column, k1, k2 (row keys), fp, component_id and keep_k1, keep_k2 of
    the component's row with the smallest id."""
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    d = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *row_keys(id_col, text_col))
    rows = cut(rows.mapInArrow(_fingerprint(shingle), f"id {d}, k1 long, k2 long, fp long"))
    best = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2")).alias("best")
    one = cut(rows.groupBy("fp").agg(best))
    roots = connected_components(links(one.select("fp"), radius, bucket_rows))
    rooted = cut(one.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "best"))
    least = rooted.groupBy("root").agg(F.min("best").alias("least"))
    where = cut(rooted.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.k1").alias("keep_k1"),
                                                  F.col("least.k2").alias("keep_k2")))
    return rows.join(where, "fp").select(F.col("id").alias(id_col), "k1", "k2", "fp", "component_id", "keep_k1", "keep_k2")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the smallest id of every component, unchanged."""
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.where("k1 = keep_k1 and k2 = keep_k2").select("k1", "k2").distinct()
    return semi_once(docs, keep, id_col, text_col)
