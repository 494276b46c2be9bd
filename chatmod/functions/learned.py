"""A scorer that is learned: one logistic model per label over hashed character n-grams, fitted by distributed sums.

Texts become sets of hashed n-grams of their words (with the borders of words, lower-cased), each weighted by how rare
it is among the labelled texts; a text's vector has length one. Features are computed once and written to the shared
folder. Every step of the fit (L-BFGS on the driver) is one job in which tasks turn their rows into sums of gradients,
added up by Spark in fixed point, so that the weights do not depend on the order of rows or tasks. The margins are then
calibrated on rows that the fit did not see, by two numbers per label.

``fit`` returns a model for ``ModelScorer``; labels without examples of both kinds score 0. Null texts count as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.functions.scoring import TEXT_AT_ONCE, ModelScorer, runs
from chatmod.session import shared_dir

BUCKETS = 1 << 16
NGRAMS = (3, 4, 5, 6)
STEPS = 15                  # gradients of one fit at most
PENALTY = 1e-4
FIXED = float(1 << 40)      # sums are integers of this many parts
CALIBRATION_FOLD = 5        # one row in so many is held back to calibrate
BINS = 64                   # of a margin unit, when calibrating
FEATURES_AT_ONCE = 1 << 20  # of the features of a batch, so many are taken at once
NEVER = -40.0               # logit of a label that was not learned


def _bytes_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, lower-cased, words set apart by one zero byte at least, and where each begins."""
    raw = [b"\0" + (t or "").lower().encode("utf-8", "surrogatepass") + b"\0" for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all texts in order, each once per text and sorted; number of buckets of each text)."""
    data, at = _bytes_of(texts)
    letter = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A)) | ((data >= 0x30) & (data <= 0x39))
    x = np.where(letter, data, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    found = []
    for n in NGRAMS:
        if len(x) < n:
            continue
        h = np.zeros(len(x) - n + 1, np.uint64)
        inner = np.ones(len(h), bool)
        for k in range(n):
            part = x[k:k + len(h)]
            h = (h ^ (part + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
            if 0 < k < n - 1:
                inner &= part > 0                       # a border only at either end
        inner &= owner[:len(h)] == owner[n - 1:]
        place = np.flatnonzero(inner)
        found.append(owner[place] * BUCKETS + ((h[place] ^ (h[place] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS)
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both % BUCKETS, np.bincount(both // BUCKETS, minlength=len(texts))


def _margins(weights: np.ndarray, rarity: np.ndarray, bucket: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of every feature, margins of every text and label); the last weight of a label is its bias."""
    value = rarity[bucket]
    row = np.repeat(np.arange(len(size)), size)
    norm = np.sqrt(np.bincount(row, value * value, len(size)))
    value = value / np.maximum(norm, 1e-12)[row]
    margins = np.zeros((len(size), len(weights)))
    for j, w in enumerate(weights):
        margins[:, j] = np.bincount(row, value * w[bucket], len(size)) + w[BUCKETS]
    return value, margins


class NgramModel:
    """``predict`` gives a logit per text and label of ``schema.LABELS``."""

    def __init__(self, labels: list[str], weights: np.ndarray, rarity: np.ndarray, scale: np.ndarray, shift: np.ndarray):
        self.labels, self.weights, self.rarity, self.scale, self.shift = labels, weights, rarity, scale, shift

    def predict(self, texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), len(S.LABELS)), NEVER)
        for lo, hi in runs(np.array([len(t) + 1 for t in texts], np.int64), TEXT_AT_ONCE):
            part = texts[lo:hi]
            _, margin = _margins(self.weights, self.rarity, *features(part))
            for j, label in enumerate(self.labels):
                if label in S.LABELS:
                    out[lo:hi, S.LABELS.index(label)] = np.clip(margin[:, j] * self.scale[j] + self.shift[j], NEVER, -NEVER)
        return out

    def scorer(self, **options) -> ModelScorer:
        return ModelScorer(lambda: self, **options)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = np.array(pc.binary_length(batch.column("text")), np.int64)
        for lo, hi in runs(length + 1, TEXT_AT_ONCE):
            part = batch.slice(lo, hi - lo)
            bucket, size = features(part.column("text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("held"), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))],
                                             names=["y", "held", "f"])


def _rows(batch: pa.RecordBatch, labels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features of some rows in order, number of features of each row, labels of each row), all rows of the batch."""
    size = np.array(batch.column("f").value_lengths(), np.int64)
    for lo, hi in runs(size + 1, FEATURES_AT_ONCE):
        part = batch.slice(lo, hi - lo)
        y = np.array(part.column("y").to_pylist(), np.float64).reshape(-1, labels)
        yield np.array(part.column("f").flatten(), np.int64), size[lo:hi], y


def _gradient(labels: int, shared):
    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rarity = shared.value
        total = np.zeros((labels, BUCKETS + 2), np.int64)        # the last column: the loss
        for bucket, size, y in (rows for batch in batches for rows in _rows(batch, labels)):
            value, margin = _margins(weights, rarity, bucket, size)
            known = ~np.isnan(y)
            z = np.where(known, margin, 0)
            error = np.where(known, 1 / (1 + np.exp(-z)) - np.where(known, y, 0), 0)
            loss = np.where(known, np.logaddexp(0, z) - np.where(known, y, 0) * z, 0)
            row = np.repeat(np.arange(len(size)), size)
            for j in range(labels):
                np.add.at(total[j], bucket, np.rint(value * error[row, j] * FIXED).astype(np.int64))
                total[j, BUCKETS] += np.rint(error[:, j] * FIXED).astype(np.int64).sum()
                total[j, BUCKETS + 1] += np.rint(loss[:, j] * FIXED).astype(np.int64).sum()
        label, at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label.astype(np.int32)), "at": pa.array(at.astype(np.int32)), "n": pa.array(total[label, at])})

    return gradient


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for lo, hi in runs(np.array(batch.column("f").value_lengths(), np.int64) + 1, FEATURES_AT_ONCE):
            n[:BUCKETS] += np.bincount(np.array(batch.column("f").slice(lo, hi - lo).flatten(), np.int64), minlength=BUCKETS)
        n[BUCKETS] += batch.num_rows
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})


def _lbfgs(objective, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise ``objective(w) -> (value, gradient)`` with at most ``steps`` evaluations."""
    value, g = objective(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    used, step = 1, 1.0 / max(1.0, np.abs(g).max())
    while used < steps and np.abs(g).max() > 1e-6:
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += (a - y @ q / (s @ y)) * s
        length = 1.0 if pairs else step
        while used < steps:
            new = w - length * q
            new_value, new_g = objective(new)
            used += 1
            if new_value <= value - 1e-4 * length * (g @ q):
                break
            length /= 2
        else:
            return w
        s, y = new - w, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        w, value, g = new, new_value, new_g
    return w


def _calibrated(counts: list, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Scale and shift of every label's margins, by Newton steps over binned margins."""
    scale, shift = np.ones(labels), np.zeros(labels)
    for j in range(labels):
        own = sorted((r.bin / BINS, r.y, r.n) for r in counts if r.label == j)      # the same sums in whatever order they came
        if len({y for _, y, _ in own}) < 2:
            continue
        x, y, n = map(np.array, zip(*own))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(n * (p - y) * x).sum() + 0.1 * (a - 1), (n * (p - y)).sum()])
            v = n * p * (1 - p)
            h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            a, b = a - d[0], b - d[1]
            if np.abs(d).max() < 1e-9:
                break
        scale[j], shift[j] = max(a, 1e-3), b
    return scale, shift


def fit(rows: DataFrame, labels: list[str], text_col: str = "text", held: F.Column | None = None, steps: int = STEPS, penalty: float = PENALTY) -> NgramModel:
    """A model of the columns ``labels`` (0, 1 or null) of ``rows``. ``held``: which rows are only used to calibrate
    (default: one in ``CALIBRATION_FOLD`` by the hash of the text)."""
    spark = rows.sparkSession
    kinds = rows.agg(*[F.sum((F.col(x) == v).cast("int")).alias(f"{x}_{v}") for x in labels for v in (0, 1)]).first()
    labels = [x for x in labels if kinds[f"{x}_0"] and kinds[f"{x}_1"]]
    k = len(labels)
    if not k:
        return NgramModel([], np.zeros((0, BUCKETS + 1)), np.zeros(BUCKETS), np.ones(0), np.zeros(0))
    held = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(CALIBRATION_FOLD)) == 0 if held is None else held
    plain = rows.select(F.array(*[F.col(x).cast("double") for x in labels]).alias("y"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    folder = shared_dir(spark, f"features-{uuid.uuid4().hex}")
    plain.mapInArrow(_featurise, "y array<double>, held boolean, f array<int>").write.parquet(folder)
    seen = spark.read.parquet(folder)
    train, rest = seen.where("not held"), seen.where("held")
    counted = train.mapInArrow(_count_features, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()      # a row per bucket
    n = np.zeros(BUCKETS + 1)
    n[np.array(counted["at"], np.int64)] = np.array(counted["n"], np.float64)
    total = max(n[BUCKETS], 1.0)
    rarity = np.log((total + 1) / (n[:BUCKETS] + 1)) + 0.05
    rarity[n[:BUCKETS] < 2] = 0.0               # seen in one text: tells nothing

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast((w.reshape(k, BUCKETS + 1), rarity))      # a fixed size
        try:
            sums = train.mapInArrow(_gradient(k, shared), "label int, at int, n long").groupBy("label", "at").agg(F.sum("n").alias("n")).toArrow()
        finally:
            shared.destroy()
        out = np.zeros((k, BUCKETS + 2))
        out[np.array(sums["label"], np.int64), np.array(sums["at"], np.int64)] = np.array(sums["n"], np.float64) / FIXED / total
        inner = w.reshape(k, BUCKETS + 1).copy()
        inner[:, BUCKETS] = 0                   # biases are free
        return out[:, -1].sum() + penalty / 2 * (inner ** 2).sum(), (out[:, :-1] + penalty * inner).ravel()

    weights = _lbfgs(objective, np.zeros(k * (BUCKETS + 1)), steps).reshape(k, BUCKETS + 1)
    shared = spark.sparkContext.broadcast((weights, rarity))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, r = shared.value
        for bucket, size, y in (rows for batch in batches for rows in _rows(batch, k)):
            _, margin = _margins(w, r, bucket, size)
            label = np.tile(np.arange(k, dtype=np.int32), len(size))
            keep = ~np.isnan(y.ravel())
            yield pa.RecordBatch.from_pydict({"label": pa.array(label[keep]), "bin": pa.array(np.rint(np.clip(margin, -30, 30) * BINS).astype(np.int32).ravel()[keep]),
                                              "y": pa.array(y.ravel()[keep].astype(np.int32))})

    counts = rest.mapInArrow(bins, "label int, bin int, y int").groupBy("label", "bin", "y").agg(F.count(F.lit(1)).alias("n")).collect()   # bins, not rows
    return NgramModel(labels, weights, rarity, *_calibrated(counts, k))
