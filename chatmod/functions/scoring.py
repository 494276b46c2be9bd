"""Pluggable scorers: text column → ``predictions`` struct of the five label scores.

* ``LexiconScorer`` — word-list hit counts, pure JVM expressions (stays inside
  whole-stage codegen, no Python hop). The default.
* ``ModelScorer`` — any Python model behind an iterator Arrow UDF: the model is
  loaded once per Python worker and fed Arrow batches, some text at a time; NFC normalisation can be
  fused into the same hop so a row crosses the JVM/Python boundary once.

Every scorer returns scores in [0, 1] rounded to 3 places, as doubles.
"""

from __future__ import annotations

import re
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.functions.text import _nfc


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def round_score(x: Column) -> Column:
    return F.round(x, S.SCORE_DECIMALS)


class Scorer:
    """Adds ``predictions`` (struct of LABELS, double) computed from ``text_col``."""

    def predictions(self, text: Column) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def score(self, df: DataFrame, text_col: str = "message_clean", out_col: str = "predictions") -> DataFrame:
        return df.withColumn(out_col, self.predictions(F.col(text_col)))


# ---------------------------------------------------------------------------
# Default lexicon, split over the labels in label order.
# ---------------------------------------------------------------------------
DEFAULT_LEXICON = {
    "toxic": ["trash", "scum"],
    "severe_toxic": ["idiot", "clown"],
    "threat": ["worthless", "moron"],
    "insult": ["pathetic", "loser"],
    "identity_hate": ["stupid", "disgusting"],
}


def lexicon_pattern(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _member_of(words: list[str]):
    return lambda w: w.isin(words)


class LexiconScorer(Scorer):
    """score(label) = round(1 - 0.5 ** hits, 3); hits = whole-word matches of the label's list.

    One hit gives 0.5 (Pending), two 0.75 (Hide), four or more ≥ 0.938 (Ban).

    When every word is made of word characters only, all labels are counted from
    one regex pass over the text: a whole-word match starting at a boundary
    spans exactly the run of word characters up to the next boundary, so at
    most one lexicon word matches at any position and the combined matches are
    the union of the per-label matches. Otherwise one pass per label is used.
    """

    def __init__(self, lexicon: dict[str, list[str]] | None = None):
        self.lexicon = lexicon or DEFAULT_LEXICON
        words = [w for l in S.LABELS for w in self.lexicon.get(l) or []]
        self.single_pass = bool(words) and all(re.fullmatch(r"\w+", w, re.ASCII) for w in words)

    def hits(self, text: Column, label: str) -> Column:
        words = self.lexicon.get(label) or []
        if not words:
            return F.lit(0)
        return F.regexp_count(text, F.lit(lexicon_pattern(words)))

    def _score(self, h: Column) -> Column:
        return round_score(F.lit(1.0) - F.pow(F.lit(0.5), h))

    def predictions(self, text: Column) -> Column:
        """One expression, one regex pass per label (usable anywhere a Column is)."""
        return F.struct(*[self._score(self.hits(text, l)).alias(l) for l in S.LABELS])

    def score(self, df: DataFrame, text_col: str = "message_clean", out_col: str = "predictions") -> DataFrame:
        """Like ``predictions``, but with a single regex pass when the lexicon allows:
        the matches are materialised once in their own projection (higher-order
        functions are not code-generated, so an inline form would rerun the regex
        per label) and counted per label from there. Text without any of the
        words as a substring has no matches and is not searched."""
        if not self.single_pass:
            return super().score(df, text_col, out_col)
        all_words = [w for l in S.LABELS for w in self.lexicon.get(l) or []]
        tmp = f"__{out_col}_matches"
        text = F.col(text_col)
        holds_one = reduce(or_, [text.contains(w) for w in all_words])
        found = df.withColumn(tmp, F.when(~holds_one, F.array().cast("array<string>"))
                              .otherwise(F.regexp_extract_all(text, F.lit(lexicon_pattern(all_words)), 1)))
        fields = []
        for label in S.LABELS:
            words = self.lexicon.get(label) or []
            h = F.size(F.filter(tmp, _member_of(words))) if words else F.lit(0)
            fields.append(self._score(h).alias(label))
        return found.withColumn(out_col, F.struct(*fields)).drop(tmp)


# ---------------------------------------------------------------------------
# Model scorer
# ---------------------------------------------------------------------------
TEXT_AT_ONCE = 1 << 20             # bytes of text a model is given at once; a longer text comes alone
MODELS_KEPT = 4                    # models a worker keeps; the one loaded first goes first
_MODELS: dict[str, object] = {}
_MODEL_LOCK = threading.Lock()


def _model_for(key: str, load: Callable[[], object]):
    """Load the model once per Python worker process (double-checked lock)."""
    model = _MODELS.get(key)
    if model is None:
        with _MODEL_LOCK:
            model = _MODELS.get(key)
            if model is None:
                model = load()
                while len(_MODELS) >= MODELS_KEPT:
                    _MODELS.pop(next(iter(_MODELS)))
                _MODELS[key] = model
    return model


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of neighbouring items whose sizes add up to at most ``most``; a larger item is a run of its own."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, end
        first = end


class ModelScorer(Scorer):
    """Scores with ``model.predict(list[str]) -> ndarray[n, 5]`` of logits.

    ``load`` is a picklable zero-argument callable run once per worker. With
    ``normalize=True`` the UDF applies NFC itself, so a caller can skip the
    separate NFC UDF and keep one Python hop per row. ``max_tokens=None``
    (default) feeds the whole text to the model.
    """

    def __init__(self, load: Callable[[], object], normalize: bool = False, max_tokens: int | None = None):
        self.load = load
        self.normalize = normalize
        self.max_tokens = max_tokens
        self.key = uuid.uuid4().hex   # of this scorer alone: an object's id may be used again

    def _udf(self):
        load, normalize, max_tokens, key = self.load, self.normalize, self.max_tokens, self.key
        ddl = ", ".join(f"{l} double" for l in S.LABELS)

        @F.arrow_udf(ddl)
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = _model_for(key, load)
            for batch in batches:
                batch = pc.fill_null(batch, "")
                probs = np.zeros((len(batch), len(S.LABELS)))
                # only a run of texts at a time is turned into Python strings and tokens, however many rows a batch has
                for first, end in runs(np.array(pc.binary_length(batch), np.int64), TEXT_AT_ONCE):
                    texts = batch.slice(first, end - first).to_pylist()
                    if normalize:
                        texts = [_nfc(t) for t in texts]
                    if max_tokens is not None:
                        texts = [" ".join(t.split()[:max_tokens]) for t in texts]
                    logits = np.asarray(model.predict(texts), dtype="float64")
                    probs[first:end] = np.round(1.0 / (1.0 + np.exp(-logits)), S.SCORE_DECIMALS)
                yield pa.StructArray.from_arrays([pa.array(p) for p in probs.T.copy()], names=S.LABELS)

        return predict

    def predictions(self, text: Column) -> Column:
        return self._udf()(text)


class HashingLinearModel:
    """Tiny bag-of-words linear model: logits = bias + Σ weight[crc32(token) % n]."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights = np.asarray(weights, dtype="float64")
        self.bias = np.asarray(bias, dtype="float64")

    @property
    def buckets(self) -> int:
        return self.weights.shape[0]

    def bucket(self, token: str) -> int:
        return zlib.crc32(token.encode("utf-8")) % self.buckets

    def predict(self, texts: list[str]) -> np.ndarray:
        """Every distinct token of the batch is hashed once; the weights of all tokens are added in one step."""
        tokens = [t.split() for t in texts]
        number = {token: k for k, token in enumerate({token for row in tokens for token in row})}
        bucket = np.array([self.bucket(token) for token in number], dtype=np.int64)
        at = np.array([number[token] for row in tokens for token in row], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), [len(r) for r in tokens])
        weighted = np.any(self.weights != 0, axis=1)[bucket][at]        # most buckets weigh nothing
        out = np.tile(self.bias, (len(texts), 1))
        np.add.at(out, row[weighted], self.weights[bucket[at[weighted]]])
        return out

    @classmethod
    def from_lexicon(cls, lexicon: dict[str, list[str]] | None = None, buckets: int = 4096,
                     weight: float = 2.0, bias: float = -4.0) -> "HashingLinearModel":
        lexicon = lexicon or DEFAULT_LEXICON
        model = cls(np.zeros((buckets, len(S.LABELS))), np.full(len(S.LABELS), bias))
        for j, label in enumerate(S.LABELS):
            for w in lexicon.get(label, []):
                model.weights[model.bucket(w), j] += weight
        return model


def lexicon_model_loader():
    """Picklable loader used by the registered model-scoring query and tests."""
    return HashingLinearModel.from_lexicon()
