"""Hard negatives by exact inner products in a residue number system.

Vectors are cut into tiles: sorted by id, a few thousand rows as one packed integer matrix. Every tile of anchors
meets every tile of rows once, as one group of a shuffle. The group multiplies the two matrices modulo several small
primes in float32 (balanced residues, depth cut so that every sum stays below 2^24 and so exact) and the residues
give the exact signed scores by Chinese remaindering in mixed radix. How many primes are needed follows from the
largest norm of the table. A first pass keeps every anchor's best rows of its own label (the positives), a second
one keeps, for each positive, the best rows of other labels whose scores lie in the window below the positive's;
window functions merge what the tiles kept.

Skew: tiles are cut from partitions by row count, so a label, an id or a vector of a third of all rows is spread as
any other. Equal scores are told apart by id inside a tile and again across tiles.

Defined cases: rows with a null label or vector or a null or non-finite component take no part; a row without id is
no anchor and comes last among equal scores; shorter vectors are filled up with zeros; an anchor's other rows are
those with another id; an id that repeats makes as many rows and, if it is an anchor's, as many anchors; vectors
whose products may exceed 2^58 raise a ValueError; extra columns are ignored; an empty table or one without anchors
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmod.llm.frames import cut
from chatmod.llm.spans import frugal

PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)   # the largest below 256 down to where all products of 2^58 fit
EXACT = 1 << 24             # float32 holds every integer up to here
TILE_ROWS, TILE_BYTES = 4096, 4 << 20
BLOCK = 1 << 20             # scores at a time
SCALE = 256.0
MOST = float(1 << 58)
FIRST = -(1 << 62)          # below any score


def moduli(bound: float) -> tuple[int, ...]:
    """The fewest primes whose product tells apart all integers from -bound to bound."""
    product = 1
    for n, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound + 2:
            return PRIMES[:n]
    raise ValueError(f"inner products may reach {bound:.3g}, more than {MOST:.3g}")


def exact_products(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """a @ b.T of integer matrices, exact if every entry lies within half the product of ``primes``."""
    digits: list[np.ndarray] = []
    for p in primes:
        depth = max(1, EXACT // ((p // 2) ** 2))
        x, y = (((m + p // 2) % p - p // 2).astype(np.float32) for m in (a, b))
        r = np.zeros((len(a), len(b)), np.int32)
        for k in range(0, a.shape[1], depth):
            r += (x[:, k:k + depth] @ y[:, k:k + depth].T).astype(np.int32) % p
        radix = 1               # the next mixed-radix digit: what is left after the digits known, divided by their primes
        for d, q in zip(digits, primes):
            r -= d * np.int32(radix % p)
            radix *= q
            r %= p
        digits.append(r * np.int32(pow(radix, -1, p)) % p)
    out = np.zeros(digits[0].shape, np.int64)
    radix = 1
    for d, p in zip(digits, primes):
        out += d.astype(np.int64) * radix
        radix *= p
    return np.where(out > radix // 2, out - radix, out)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of every row, ties by smaller column."""
    masked = np.where(allowed, score, FIRST)
    if masked.shape[1] > k:
        least = -np.partition(-masked, k - 1, axis=1)[:, k - 1:k]
        allowed = allowed & (masked >= least)
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _numbers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors are whole, their components floor(scale * x) as a matrix of floats)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    known = np.array(flat.is_valid(), bool)
    x = np.array(flat.fill_null(np.nan), np.float64)
    owner = np.repeat(np.arange(len(column)), sizes)
    whole = np.array(column.is_valid(), bool)
    whole[owner[~known | ~np.isfinite(x)]] = False
    width = int(sizes[whole].max(initial=0))
    out = np.zeros((len(column), width))
    inside = whole[owner]
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[owner[inside], place[inside]] = np.floor(scale * x[inside])
    return whole, out[whole]


_PACKED = "tile long, n long, width long, norm double, ids binary, known binary, labels binary, kind string, vectors binary"


def _pack(scale: float, tile_rows: int):
    def tile(number: int, ids: list, known: list, labels: list, vectors: list) -> pa.RecordBatch:
        ids, known, labels = np.concatenate(ids), np.concatenate(known), np.concatenate(labels)
        width = max(v.shape[1] for v in vectors)
        x = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])
        order = np.lexsort((ids, ~known))
        x = x[order]
        norm = float(np.square(x).sum(axis=1).max(initial=0))
        fits = norm < MOST
        kind = next(k for k in ("<i2", "<i4", "<i8") if not fits or np.abs(x).max(initial=0) <= np.iinfo(k).max)
        return pa.RecordBatch.from_pylist([{
            "tile": number, "n": len(ids), "width": width, "norm": norm, "ids": ids[order].tobytes(), "known": known[order].tobytes(),
            "labels": labels[order].tobytes(), "kind": kind, "vectors": (x if fits else x * 0).astype(kind).tobytes()}], schema=_SCHEMA)

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        for batch in batches:
            whole, x = _numbers(batch.column("vector"), scale)
            id_column = batch.column("id").filter(pa.array(whole))
            ids = np.array(id_column.fill_null(0), np.int64)
            known = np.array(id_column.is_valid(), bool)
            labels = np.array(batch.column("label").filter(pa.array(whole)), np.int64)
            limit = max(1, min(tile_rows, TILE_BYTES // (8 * max(1, x.shape[1]))))
            for lo in range(0, len(x), limit):
                part = slice(lo, lo + limit)
                if held and size + len(x[part]) > limit:
                    yield tile(number, *map(list, zip(*held)))
                    number, held, size = number + 1, [], 0
                held.append((ids[part], known[part], labels[part], x[part]))
                size += len(x[part])
        if size:
            yield tile(number, *map(list, zip(*held)))

    return pack


_SCHEMA = pa.schema([("tile", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("norm", pa.float64()), ("ids", pa.binary()),
                     ("known", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())])


class _Tile:
    def __init__(self, row: dict, width: int):
        self.number, self.positives = row["tile"], row.get("positives")
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["width"]).astype(np.int64)
        self.vectors = np.pad(vectors, ((0, 0), (0, width - row["width"])))

    def id_of(self, rows: np.ndarray) -> pa.Array:
        return pa.array(self.ids[rows], mask=~self.known[rows])


def _blocks(a: _Tile, b: _Tile, primes: tuple[int, ...]):
    """(first anchor, scores) of some anchors against all rows at a time."""
    step = max(1, BLOCK // max(1, len(b.ids)))
    for lo in range(0, len(a.ids), step):
        yield lo, exact_products(a.vectors[lo:lo + step], b.vectors, primes)


def _positives(width: int, primes: tuple[int, ...], k: int):
    def positives(a: _Tile, b: _Tile) -> Iterator[pa.Table]:
        for lo, score in _blocks(a, b, primes):
            own = slice(lo, lo + len(score))
            other = (b.labels == a.labels[own, None]) & ((b.ids != a.ids[own, None]) | ~b.known)
            i, j = best(score, other, k)
            yield pa.table({"tile": np.full(len(i), a.number), "anchor": i + lo, "anchor_id": a.ids[i + lo], "positive_id": b.id_of(j),
                            "positive_score": score[i, j]})

    return positives


def _negatives(width: int, primes: tuple[int, ...], k: int, low: tuple[int, int]):
    def negatives(a: _Tile, b: _Tile) -> Iterator[pa.Table]:
        anchor, slot = (np.array([p[c] for p in a.positives], np.int64) for c in ("anchor", "slot"))
        top = np.array([p["positive_score"] for p in a.positives], np.int64)
        for lo, score in _blocks(a, b, primes):
            for s in range(1, int(slot.max(initial=0)) + 1):
                at = np.flatnonzero((slot == s) & (anchor >= lo) & (anchor < lo + len(score)))
                mine, limit = score[anchor[at] - lo], top[at, None]
                # low / 100 * positive <= negative <= positive, in integers
                inside = (b.labels != a.labels[anchor[at], None]) & (mine <= limit) & (mine * low[1] >= limit * low[0])
                i, j = best(mine, inside, k)
                yield pa.table({"tile": np.full(len(i), a.number), "anchor": anchor[at][i], "slot": slot[at][i], "negative_id": b.id_of(j),
                                "negative_score": mine[i, j]})

    return negatives


def _each_pair(work, width: int, names: list[str]):
    """A function over two groups of packed tiles: ``work`` on every pair."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [pa.table({c: pa.array([], pa.int64()) for c in names})]
        rows = [_Tile(r, width) for r in right.to_pylist()]
        for one in left.to_pylist():
            a = _Tile(one, width)
            for b in rows:
                parts += work(a, b)
        return pa.concat_tables(parts)

    return run


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5,
         negatives: int = 5, window: tuple[int, int] = (4, 5), scale: float = SCALE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``is_anchor`` holds (an expression over id, label). For each anchor and each of its best
    ``positives`` rows of the same label come the best ``negatives`` rows of other labels whose score is at most the
    positive's and at least window[0] / window[1] of it."""
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    plain = plain.where("label is not null and vector is not null")
    packed = cut(plain.mapInArrow(_pack(scale, tile_rows), _PACKED))
    anchors = plain.where(is_anchor & F.col("id").isNotNull())
    parts = max(1, -(-anchors.count() // tile_rows))
    asked = cut(anchors.repartition(parts).mapInArrow(_pack(scale, tile_rows), _PACKED))
    size = packed.agg(F.max("width"), F.max("norm"), F.count("*")).first()
    tiles = asked.count()
    width, norm, n = int(size[0] or 0), float(size[1] or 0), size[2] * tiles
    if norm >= MOST:
        raise ValueError(f"inner products may reach {norm:.3g}, more than {MOST:.3g}")
    primes = moduli(1.01 * norm + 1)
    # one group per pair of tiles: anchors in blocks against all rows
    tasks = max(1, min(n, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 8)))
    columns = ["tile", "n", "width", "kind", "ids", "known", "labels", "vectors"]
    own = F.pmod(F.xxhash64("tile"), F.lit(max(1, size[2]))).cast("int"), F.pmod(F.xxhash64("tile"), F.lit(max(1, tiles))).cast("int")
    every = [F.explode(F.sequence(F.lit(0), F.lit(max(0, k - 1)))) for k in (size[2], tiles)]
    right = packed.select(*columns, own[0].alias("b"), every[1].alias("a")).repartition(tasks, "a", "b")

    def pairs(of: DataFrame, work, names: list[str]) -> DataFrame:
        of = of.select(*[c for c in of.columns if c in (*columns, "positives")], own[1].alias("a"), every[0].alias("b")).repartition(tasks, "a", "b")
        return of.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_each_pair(work, width, names), ", ".join(f"{c} long" for c in names))

    near = pairs(asked, _positives(width, primes, positives), ["tile", "anchor", "anchor_id", "positive_id", "positive_score"])
    place = Window.partitionBy("tile", "anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    near = cut(near.withColumn("slot", F.row_number().over(place)).where(F.col("slot") <= positives))
    asks = near.groupBy("tile").agg(F.collect_list(F.struct("anchor", "slot", "positive_score")).alias("positives"))      # of one tile
    hard = pairs(asked.join(asks, "tile"), _negatives(width, primes, negatives, window), ["tile", "anchor", "slot", "negative_id", "negative_score"])
    place = Window.partitionBy("tile", "anchor", "slot").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    hard = hard.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    return hard.join(near, ["tile", "anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
