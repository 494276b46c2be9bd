"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Training (labelled rows outside the held-out fold only): words and word beginnings are counted per toxic and
clean text, one count per distinct text; those that mark toxic texts significantly become the lexicon, with
their log odds as evidence. Scoring: every distinct word of a slice runs through the lexicon's trie
intersected with a Levenshtein automaton, determinised as words need it, which finds exact terms, terms with
up to ``EDITS`` edits and beginnings. Hits add up over a context window; hits inside quotation marks count a
fraction. A logistic regression over a few sums of that kind gives the score.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of their id
among the labels that meet a document) and keeps at most ``MOST_TERMS`` terms; scoring covers every row and the whole text.

Defined cases: null and empty texts have no hits and get the score of the intercept; without labels of both
classes among the documents nothing tells toxic texts, every score is 0, no text is called toxic, and a warning is given; rows that repeat score alike; a document
with several labels counts as toxic if one of them says so. Extra columns pass through; columns named like a
result are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmod.llm.spans import LOWER, frugal, slices, utf8, Words

SAMPLE_ROWS = 40_000        # labelled rows the classifier is fitted on
MOST_TERMS = 4_000
LEAST_TEXTS, LEAST_G2, LEAST_ODDS = 4, 15.0, 1.5    # a term's toxic texts, likelihood ratio, log odds
BEGINNINGS = range(4, 9)    # bytes of a word's beginning
EDITS, EDIT_LENGTH = 1, 5   # edits allowed in terms of at least so many characters
MOST_STATES = 200_000
WINDOW = 12                 # words to either side of a hit
QUOTED = 0.25               # what a quoted hit counts
QUOTE_REACH = 60            # words within which a quotation must close
FOLDS = 5

LETTERS = np.ones(256, bool)    # bytes of words after lower-casing
LETTERS[0x00:0x30] = LETTERS[0x3A:0x61] = LETTERS[0x7B:0x80] = False
N_FEATURES = 6


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


class LexiconAutomaton:
    """A trie of terms and beginnings, run together with a Levenshtein automaton.

    A state is a set of (trie node, edits so far); it is built from its predecessor when a word first gets
    there. ``find(word)`` is (number of the best entry, its edits), or None.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], edits: int = EDITS, edit_length: int = EDIT_LENGTH):
        self.edits = edits
        self.evidence = [w for _, _, w in terms]
        self.children: list[dict[str, int]] = [{}]
        self.term, self.begin, self.fuzzy = [-1], [-1], [False]     # entry that ends here; whether edits may lead here
        for i, (text, beginning, _) in enumerate(terms):
            node = 0
            path = [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.begin.append(-1)
                    self.fuzzy.append(False)
                node = self.children[node][c]
                path.append(node)
            (self.begin if beginning else self.term)[node] = i
            if not beginning and len(text) >= edit_length:
                for p in path:
                    self.fuzzy[p] = True
        self.edit_length = edit_length
        self.length = [len(t) for t, _, _ in terms]
        self._forget()

    def _forget(self):
        start = self._close({(0, 0)})
        self.states, self.number, self.next = [start], {start: 0}, {}
        self.result: list[tuple | None] = [self._accept(start)]

    def _close(self, places: set[tuple[int, int]]) -> frozenset:
        todo = list(places)
        while todo:                     # a letter of the term that the word leaves out
            node, e = todo.pop()
            if e < self.edits:
                for child in self.children[node].values():
                    if self.fuzzy[child] and (child, e + 1) not in places:
                        places.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in places:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def _accept(self, state: frozenset) -> tuple | None:
        best = None
        for node, e in state:
            i = self.term[node]
            if i >= 0 and (e == 0 or self.length[i] >= self.edit_length):
                best = max(best or (-9, 0.0, -1), (-e, self.evidence[i], i))
        return best

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, e in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, e))
            if e < self.edits and self.fuzzy[node]:
                after.add((node, e + 1))                                        # a letter too many
                after.update((x, e + 1) for x in self.children[node].values() if self.fuzzy[x])   # another letter
        key = self._close(after)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.result.append(self._accept(key))
        out = self.number[key] if key else -1
        self.next[state, c] = out
        return out

    def find(self, word: str) -> tuple[int, int] | None:
        if len(self.states) > MOST_STATES:
            self._forget()
        state, known, node, begun = 0, self.next, 0, -1
        for c in word:
            if node >= 0:
                node = self.children[node].get(c, -1)
                if node >= 0 and self.begin[node] >= 0 and (begun < 0 or self.evidence[self.begin[node]] > self.evidence[begun]):
                    begun = self.begin[node]
            if state >= 0:
                to = known.get((state, c))
                state = self._step(state, c) if to is None else to
            if state < 0 and node < 0:
                break
        best = self.result[state] if state >= 0 else None
        if best is not None and best[0] == 0 and (begun < 0 or best[1] >= self.evidence[begun]):
            return best[2], 0
        if begun >= 0:
            return begun, 0
        return (best[2], -best[0]) if best is not None else None


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool, float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * (N_FEATURES + 1))

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6)


def _quoted(data: np.ndarray, offsets: np.ndarray, words: Words, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each word (number ``at`` of text ``doc``) stands between two quotation marks of its text."""
    mark = np.flatnonzero(data == 0x22)
    if not len(mark) or not len(at):
        return np.zeros(len(at), bool)
    owner = np.searchsorted(words.begin, mark)              # the word each mark stands before
    text = np.searchsorted(offsets, mark, "right") - 1
    place = np.searchsorted(mark, words.begin[at])
    first = np.searchsorted(text, doc)
    inside = (place - first) % 2 == 1
    close = np.minimum(place, len(mark) - 1)
    return inside & (place < len(mark)) & (text[close] <= doc) & (owner[close] - at <= QUOTE_REACH)


def _features(machine: LexiconAutomaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of hits) of every text."""
    n = len(offsets) - 1
    out, count = np.zeros((n, N_FEATURES)), np.zeros(n, np.int64)
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo]:offsets[hi]]]
        ends = offsets[lo:hi + 1] - offsets[lo]
        words = Words(part, ends, LETTERS)
        if not len(words):
            continue
        every = np.arange(len(words))
        start, end = words.span(every, every + 1)
        group, first = words.group(start, end)
        raw = words.data.tobytes()
        found = [machine.find(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start[first].tolist(), end[first].tolist())]
        entry = np.array([-1 if f is None else f[0] for f in found])
        fuzzy = np.array([f is not None and f[1] > 0 for f in found])
        hit = np.flatnonzero(entry[group] >= 0)
        if not len(hit):
            continue
        entry, fuzzy = entry[group[hit]], fuzzy[group[hit]]
        doc = np.searchsorted(words.first, hit, "right") - 1
        quoted = _quoted(part, ends, words, doc, hit)
        worth = np.array(machine.evidence)[entry] * np.where(quoted, QUOTED, 1.0)
        exact, near = np.where(fuzzy, 0, worth), np.where(fuzzy, worth, 0)
        place = hit + doc * (2 * WINDOW + 1)                # texts a window apart
        total = np.concatenate([[0], np.cumsum(exact + near / 2)])
        window = total[np.searchsorted(place, place + WINDOW, "right")] - total[np.searchsorted(place, place - WINDOW)]
        most = np.zeros(hi - lo)
        np.maximum.at(most, doc, window)
        _, once = np.unique(np.stack([doc, entry], axis=1), axis=0, return_index=True)
        tally = lambda w, at=slice(None): np.bincount(doc[at], weights=w[at].astype(float), minlength=hi - lo)
        count[lo:hi] = tally(np.ones(len(hit)))
        out[lo:hi] = np.stack([
            np.log1p(most), np.log1p(tally(exact, once)), np.log1p(tally(near, once)), np.log1p(tally(np.ones(len(hit)), once)),
            tally(quoted) / np.maximum(count[lo:hi], 1), np.log1p(100 * tally(exact) / np.maximum(np.diff(words.first), 1))], axis=1)
    return out, count


@frugal
def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: terms (whole words and beginnings) with the numbers of toxic and clean texts that hold them."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in slices(offsets):
            words = Words(LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo], LETTERS)
            every = np.arange(len(words))
            start, end = words.span(every, every + 1)
            doc = np.searchsorted(words.first, every, "right") - 1
            group, first = words.group(start, end)
            pair = np.unique(np.stack([group, doc], axis=1), axis=0)        # every word once per text
            start, end, group, doc = start[first], end[first], pair[:, 0], pair[:, 1]
            raw = words.data.tobytes()
            for size in (0, *BEGINNINGS):
                if size:
                    long = (end - start > size) & (words.data[np.minimum(start + size, len(words.data) - 1)] & 0xC0 != 0x80)
                    rows = np.flatnonzero(long[group])
                    stem, rep = words.group(start[long], start[long] + size)
                    number = np.full(len(start), -1)
                    number[long] = stem
                    of = np.unique(np.stack([number[group[rows]], doc[rows]], axis=1), axis=0)
                    a, b = start[long][rep], start[long][rep] + size
                else:
                    of, a, b = pair, start, end
                t = np.bincount(of[:, 0], weights=toxic[lo:hi][of[:, 1]], minlength=len(a)).astype(np.int64)
                n = np.bincount(of[:, 0], minlength=len(a))
                yield pa.RecordBatch.from_pydict({
                    "term": pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist())], pa.string()),
                    "beginning": pa.array(np.full(len(a), bool(size))), "toxic": pa.array(t), "clean": pa.array(n - t)})


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Logistic regression by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, most_terms: int = MOST_TERMS) -> ToxicityModel:
    """A model from the labelled rows outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    known = known.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi")       # only labels that meet a document
    known = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))       # at most sample_rows small rows
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known, "__id")
    one = texts.groupBy(F.xxhash64("text")).agg(F.min("__id").alias("__id"), F.max("toxic").alias("toxic"))
    one = one.groupBy("__id").agg(F.max("toxic").alias("toxic")).persist()              # one row per distinct text
    try:
        totals = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
        n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
        if not n_toxic or not n_clean:
            warnings.warn(f"toxicity: {n_toxic} toxic and {n_clean} clean labelled texts, no text will be called toxic", stacklevel=2)
            return ToxicityModel(weights=[-40.0] + [0.0] * N_FEATURES)
        texts = texts.drop("toxic").join(F.broadcast(one), "__id")
        counts = texts.select("text", "toxic").mapInArrow(_count_terms, "term string, beginning boolean, toxic long, clean long")
        counts = counts.groupBy("term", "beginning").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        a, b = F.col("a"), F.col("b")
        odds = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))
        share = F.lit(n_toxic / (n_toxic + n_clean))
        part = lambda k, p: F.when(k > 0, k * F.log(k / ((a + b) * p))).otherwise(0.0)
        g2 = 2 * (part(a, share) + part(b, 1 - share))
        picked = counts.where(a >= LEAST_TEXTS).withColumn("odds", odds).withColumn("g2", F.round(g2, 9)).where(
            (F.col("g2") >= LEAST_G2) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("g2"), "term", "beginning").limit(most_terms)
        model = ToxicityModel([(r.term, r.beginning, r.odds) for r in picked.collect()])
        made = texts.select("__id", "toxic", "text").mapInArrow(
            _feature_rows(model.terms), "__id string, toxic int, f array<double>").distinct().collect()     # at most sample_rows
        made.sort()
        model.weights = _fit_weights(np.array([r.f for r in made]), np.array([r.toxic for r in made], float))
        return model
    finally:
        one.unpersist()


def _feature_rows(terms: list):
    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = LexiconAutomaton(terms)
        for batch in batches:
            x, _ = _features(machine, *utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.string()), batch.column("toxic").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["__id", "toxic", "f"])

    return rows


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (0 or 1) and n_hits (words that matched the lexicon)."""
    rows = docs.drop("score", "predicted", "n_hits")

    @frugal
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = LexiconAutomaton(model.terms)
        for batch in batches:
            x, hits = _features(machine, *utf8(batch.column(text_col)))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(hits)],
                                             names=[*batch.schema.names, "score", "predicted", "n_hits"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("n_hits", T.LongType())])
    return rows.mapInArrow(judge, schema)
