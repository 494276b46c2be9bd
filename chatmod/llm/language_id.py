"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per page:
- the text: a naive Bayes model over hashed letter trigrams, fitted on labelled documents; the log likelihood is
  tempered, as neighbouring trigrams are not independent, and bounded;
- the language the markup declares and the suffix of the address: their reliability is learned from the pages
  themselves, as counts of (declared or suffix, language believed from the text) by grouped aggregation;
- the host: a prior smoothed along host, domain and all pages, each level's counts (of language beliefs) filled
  up with ``PRIOR_ROWS`` pages of the level above. A page's own belief is taken out of its host's counts.

The text model is fitted on at most ``SAMPLE_ROWS`` labelled documents (smallest hash of the id); all counts
over pages cover every page.

Defined cases: a null or empty page has no text evidence and no declaration; a null address has the host "";
pages that repeat count as often as they occur; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmod.llm.frames import cut
from chatmod.llm.spans import LOWER, SPACES, frugal, slices, utf8

SAMPLE_ROWS = 10_000
CELL_BITS = 16
TEMPER = 0.05           # weight of one trigram's log likelihood
MOST_TEXT = 12.0        # bound of the text's log likelihood ratio
PRIOR_ROWS = 5.0        # pages of the level above that a host or domain starts with
SMOOTH = 1.0            # pseudo-count of declared languages and suffixes

_OPENS = re.compile(r"(?i)<(?:!--|(script|style|noscript|template)\b)")
_CLOSES = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template")}
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?\s*([a-z]{2,3})""")


def _without_hidden(page: str) -> str:
    """The page with comments and the elements that are not shown replaced by a space, in one pass: an end that is missing
    is looked for once."""
    parts, at, missing = [], 0, set()
    found = _OPENS.search(page)
    while found:
        name = (found[1] or "").lower()
        end = -1
        if name not in missing:
            if name:
                close = _CLOSES[name].search(page, found.end())
                end = close.end() if close else -1
            else:
                end = page.find("-->", found.end())
                end = end + 3 if end >= 0 else -1
            if end < 0:
                missing.add(name)
        if end >= 0:
            parts += [page[at:found.start()], " "]
            at = end
        found = _OPENS.search(page, end if end >= 0 else found.start() + 1)
    return "".join(parts) + page[at:]


def _without_tags(page: str) -> str:
    """Every ``<`` up to the next ``>`` replaced by a space."""
    parts, at = [], 0
    while (start := page.find("<", at)) >= 0 and (end := page.find(">", start)) >= 0:
        parts += [page[at:start], " "]
        at = end + 1
    return "".join(parts) + page[at:]


def visible_text(page: str) -> str:
    return html.unescape(_without_tags(_without_hidden(page)))


def declared_language(page: str) -> str:
    """The language named in the first html tag that names one, two letters; "" without."""
    found = _HTML.search(page)
    while found:
        end = page.find(">", found.end())
        end = len(page) if end < 0 else end
        lang = _LANG.search(page, found.end(), end)
        if lang:
            return lang[1].lower()[:2]
        found = _HTML.search(page, end)             # a tag inside this one would hold less of it
    return ""


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams that lie within one text and hold a letter at their middle, and their texts."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.where(SPACES[data], 0x20, LOWER[data]).astype(np.uint64)
    h = (x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]) * np.uint64(0x9E3779B97F4A7C15)
    letter = (x[1:-1] >= 0x61) & (x[1:-1] <= 0x7A) | (x[1:-1] >= 0x80)
    inside = np.ones(len(data), bool)
    for k in (0, 1):
        edge = offsets[1:] - 1 - k
        inside[edge[edge >= 0]] = False
    at = np.flatnonzero(letter & inside[:-2])
    return (h[at] >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def _count_grams(languages: list[str]):
    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(languages), 1 << CELL_BITS), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lang = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])
            for lo, hi in slices(offsets):
                cell, doc = _grams(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                np.add.at(n, (lang[doc + lo], cell), 1)
        row, cell = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([languages[i] for i in row], pa.string()),
                                          "cell": pa.array(cell.astype(np.int32)), "n": pa.array(n[row, cell])})

    return count


def fit_text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of every cell per language)."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    pick = known.select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)   # at most sample_rows ids
    texts = known.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(
        F.broadcast(pick.distinct()), "__id")
    languages = sorted(r.lang for r in texts.select("lang").distinct().collect())
    counts = np.full((len(languages), 1 << CELL_BITS), 0.5)
    made = texts.select("text", "lang").mapInArrow(_count_grams(languages), "lang string, cell int, n long")
    for r in made.groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():     # at most languages * 2**CELL_BITS rows
        counts[languages.index(r.lang), r.cell] += r.n
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _text_evidence(log_p: np.ndarray):
    @frugal
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [x or "" for x in batch.column("__html").to_pylist()]
            declared = [declared_language(p) for p in pages]
            data, offsets = utf8(pa.array([visible_text(p) for p in pages], pa.large_string()))
            score = np.zeros((len(pages), len(log_p)))
            for lo, hi in slices(offsets):
                cell, doc = _grams(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for k in range(len(log_p)):
                    score[lo:hi, k] = np.bincount(doc, weights=log_p[k][cell], minlength=hi - lo)
            score = np.maximum(TEMPER * (score - score.max(axis=1, keepdims=True, initial=-np.inf)), -MOST_TEXT)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in batch.schema.names if n != "__html"), pa.array(declared, pa.string()),
                 pa.array(list(np.round(score, 9)), pa.list_(pa.float64()))],
                names=[*(n for n in batch.schema.names if n != "__html"), "declared", "text_ll"])

    return evidence


def _normal(scores: list[Column]) -> list[Column]:
    """Probabilities from log scores."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    weights = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, weights)
    return [w / total for w in weights]


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: its id column, host, suffix, declared, text_lang, lang, posterior (of lang) and p (all posteriors
    in the order of the sorted languages)."""
    languages, log_p = fit_text_model(docs, sample_rows=sample_rows)
    kind = pages.schema[id_col].dataType
    names = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "domain", "suffix", "declared")])
    k = len(languages)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
                        F.substring_index(host, ".", -1).alias("suffix"), F.col(html_col).alias("__html"))
    schema = T.StructType([T.StructField(id_col, kind), *names.fields[:3], names.fields[3], T.StructField("text_ll", T.ArrayType(T.DoubleType()))])
    rows = rows.mapInArrow(_text_evidence(log_p), schema)
    if not languages:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("text_lang", "string"), ("lang", "string"), ("posterior", "double"), ("p", "array<double>"))]
        return rows.select(id_col, "host", "suffix", "declared", *nothing)
    text = [F.col("text_ll")[i] for i in range(k)]
    rows = cut(rows.select(id_col, *names.fieldNames(), "text_ll", *[p.alias(f"b{i}") for i, p in enumerate(_normal(text))]))
    beliefs = [f"b{i}" for i in range(k)]

    def counts(*keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(b).alias(f"{keys[-1] if keys else 'all'}_{b}") for b in beliefs])

    # all pages: k numbers
    everywhere = counts().first()
    total = [float(x or 0.0) for x in everywhere]
    base = [(x + 1.0) / (sum(total) + k) for x in total]

    domain = cut(counts("domain"))
    by_host = cut(counts("domain", "host"))
    declared, suffix = cut(counts("declared")), cut(counts("suffix"))

    joined = (rows.join(by_host.drop("domain"), "host").join(domain, "domain").join(declared, "declared").join(suffix, "suffix"))

    def smooth(counted: list[Column], above: list[Column]) -> list[Column]:
        n = reduce(lambda a, b: a + b, counted)
        return [(c + PRIOR_ROWS * a) / (n + PRIOR_ROWS) for c, a in zip(counted, above)]

    own = [F.col(b) for b in beliefs]
    without = lambda level: [F.greatest(F.col(f"{level}_{b}") - o, F.lit(0.0)) for b, o in zip(beliefs, own)]
    prior = smooth(without("host"), smooth(without("domain"), [F.lit(x) for x in base]))

    def given(level: str, i: int) -> Column:
        """Log probability of the page's value at ``level`` if its language is i."""
        return F.log((F.greatest(F.col(f"{level}_b{i}") - own[i], F.lit(0.0)) + SMOOTH * F.lit(base[i])) / (total[i] + SMOOTH))

    scores = [text[i] + F.log(prior[i]) + given("declared", i) + given("suffix", i) for i in range(k)]
    scored = joined.select(id_col, "host", "suffix", "declared", "text_ll", *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    p = F.array(*[F.round(x, 9) for x in _normal([F.col(f"s{i}") for i in range(k)])])
    best = lambda values: F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(values, F.array_max(values)).cast("int"))
    return scored.withColumn("p", p).select(id_col, "host", "suffix", "declared", best(F.col("text_ll")).alias("text_lang"),
                                            best(F.col("p")).alias("lang"), F.array_max("p").alias("posterior"), "p")
