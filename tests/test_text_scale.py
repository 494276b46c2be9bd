"""Work per row, per task and per worker as the tables grow: text steps, spreading, batches given to models, chat pages."""

import random
import re
import unicodedata
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod import session
from chatmod.functions import learned as L
from chatmod.functions import nfc, scoring
from chatmod.functions.text import clean_messages, single_spaces
from chatmod.operators import offsets as O
from chatmod.plans import catalog, views


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tables(spark, scratch):
    """One file of events and one of documents, some texts null, empty or not composed."""
    texts = [None, "", "e\u0301t\u00e9 \U0001f600", "plain " * 50, "caf\u00e9  trash\tand\n\nmore", "\ud55c\uae00"] + [f"text {i}" for i in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = ["click", "view", "error", "purchase", None]
    events = spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 20, i % 24), i % 7, kinds[i % 5], float(i % 50)) for i in range(900)],
                                   "event_id long, ts timestamp, user_id long, event_type string, value double")
    docs.coalesce(1).write.parquet(f"{scratch}/documents.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{scratch}/events.parquet")
    return scratch, texts


def test_nfc_class_holds_what_may_change_and_no_common_letters(spark):
    inside, _ = nfc._patterns()
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    frame = spark.createDataFrame([(c, chr(c)) for c in codes if unicodedata.category(chr(c)) not in ("Cn", "Co")], "c int, t string")
    got = {r.c for r in frame.where(F.col("t").rlike(inside)).select("c").collect()}
    known = {r.c for r in frame.select("c").collect()}
    odd = nfc._tables()["odd"] & known
    assert odd <= got and min(got) == 0x300
    assert not got & {ord(x) for x in "\u2014\u2019\u201c\u2026\u20ac\u0430\u044f\u4e2d\uac00\U0001f600"}


def test_a_character_meets_few_ranges():
    """A character far from the odd ones is compared with the two outermost spans, not with every range."""
    inside, _ = nfc._patterns()
    ranges = re.findall(r"\\x\{[0-9A-F]+\}-\\x\{[0-9A-F]+\}(?!&&)", inside)
    spans = re.findall(r"&&", inside)
    assert len(ranges) > 50 and len(spans) >= len(ranges) // 3
    assert len(re.findall(r"^\[\[", inside)) == 1 and "p{M}" not in inside


def test_single_spaces_equals_the_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \t\n\x0b\f\rab\u00a0\u2003") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", "a b", "a\nb"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = frame.select("i", F.regexp_replace("t", S.WHITESPACE_PATTERN, " ").alias("t"))
    assert sorted(single_spaces(frame, "t").collect()) == sorted(want.collect())
    cleaned = _plan(clean_messages(frame, "t"))
    assert S.WHITESPACE_PATTERN not in cleaned                     # single spaces are not rewritten one by one


def test_lexicon_searches_only_texts_that_hold_a_word(spark):
    texts = ["you idiot, trash!", "trashy idiots", "nothing here", "", None, "trash trash scum worthless"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    scorer = scoring.LexiconScorer()
    scored = scorer.score(frame, "t", "p")
    assert "CASE WHEN" in _plan(scored).split("regexp_extract_all")[0] and "Contains(t" in _plan(scored)
    assert [r.p for r in scored.orderBy("i").collect()] == [r.p for r in frame.select("i", scorer.predictions(F.col("t")).alias("p")).orderBy("i").collect()]


def test_one_large_file_is_dealt_for_text_work(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_MAX_BYTES", 100)
    monkeypatch.setattr(session, "SPREAD_MAX_BYTES_PER_TASK", 100)
    folder, _ = tables
    assert "hashpartitioning(doc_id" in _plan(catalog.QUERIES["clean_messages_nfd"](spark, folder))
    assert "Exchange" not in _plan(session.spread_for_cpu(views.table(spark, folder, "documents")))
    parts = session.spread_for_cpu(views.table(spark, folder, "documents"), any_size=True).rdd.getNumPartitions()
    assert parts > spark.sparkContext.defaultParallelism            # a task's share does not grow with the file


def test_versioned_batches_are_dealt(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_MAX_BYTES", 100)
    monkeypatch.setattr(session, "SPREAD_MAX_BYTES_PER_TASK", 1000)
    folder, _ = tables
    seen = []
    monkeypatch.setattr(catalog, "process_batch", lambda batch, *a, **k: seen.append(batch))
    monkeypatch.setattr(catalog.VersionedStore, "compact", lambda self: None)
    catalog._versioned_store(spark, folder)
    assert [b.rdd.getNumPartitions() > 4 for b in seen] == [True] * 4
    assert seen[-1].count() == 900


def test_models_are_given_some_text_at_a_time(spark):
    most = scoring.TEXT_AT_ONCE
    long = most + 5

    class AtMost:
        """Refuses more text at once than a worker should hold."""

        def predict(self, texts):
            assert len(texts) == 1 or sum(len(t.encode()) for t in texts) <= most
            return np.array([[len(t) % 7 - 3] * 5 for t in texts], float)

    frame = spark.range(3000).select("id", F.expr(f"case when id = 7 then repeat('x', {long}) when id = 8 then null else repeat('ab ', 400 + id % 5) end").alias("t"))
    out = scoring.ModelScorer(AtMost).score(frame.coalesce(1), "t", "p").select("id", "p.toxic").collect()
    length = lambda i: long if i == 7 else 0 if i == 8 else 3 * (400 + i % 5)
    assert len(out) == 3000 and all(r.toxic == round(1 / (1 + np.exp(3 - length(r.id) % 7)), 3) for r in out)


def test_features_are_taken_some_at_a_time(monkeypatch):
    monkeypatch.setattr(L, "FEATURES_AT_ONCE", 10)
    sizes = [0, 3, 4, 12, 0, 1, 9, 2]
    f = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array([[float(i), None] for i in range(8)]), f], ["y", "f"]).slice(1)
    got = list(L._rows(batch, 2))
    assert all(len(bucket) <= 10 or len(size) == 1 for bucket, size, _ in got) and len(got) > 2
    assert np.concatenate([g[0] for g in got]).tolist() == [x for n in sizes[1:] for x in range(n)]
    assert np.concatenate([g[1] for g in got]).tolist() == sizes[1:]
    assert np.concatenate([g[2] for g in got])[:, 0].tolist() == list(range(1, 8))


def test_pages_hold_every_text_and_move_it_packed(spark, tables):
    folder, texts = tables
    pages = views.chat_pages(spark, folder)
    assert "collect_list" not in _plan(pages) and pages.schema["items"].dataType.simpleString() == S.CHAT_PAGE_SCHEMA["items"].dataType.simpleString()
    out = {int(r.commentId): r.message for r in catalog.QUERIES["flatten_chat_pages"](spark, folder).collect()}
    assert out == {i: texts[i % len(texts)] for i in range(900) if i % 5 != 2}
    assert pages.where(F.size("items") > views.PAGE_SIZE).count() == 0


def _shuffled(plan):
    """Bytes of the rows that the exchanges of an executed plan have moved."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def _events_and_docs(spark, folder, ids, docs):
    rows = [(i, datetime(2024, 1, 1 + k % 20), k % 7, ["click", "error", None, "view"][k % 4], float(k % 50)) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return [r[3] for r in rows]


def test_a_text_moves_once_for_the_pages_that_share_it(spark, scratch):
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(0x4e00, 0x9fff)) for _ in range(2000)) for _ in range(300)]    # hardly smaller when packed
    kinds = _events_and_docs(spark, scratch, range(6000), list(enumerate(texts)))
    out = catalog.QUERIES["flatten_chat_pages"](spark, scratch)
    assert {int(r.commentId): r.message for r in out.collect()} == {i: texts[i % 300] for i in range(6000) if kinds[i] != "error"}
    assert 300 * 3000 < _shuffled(out._jdf.queryExecution().executedPlan()) < 6000 * 1000    # texts of 6,000 bytes, 20 events each


@pytest.mark.parametrize("docs, groups", [(19, (3, 1)), (19, (1000, 64)), (700, (50, 1)), (1, (1000, 64)), (0, (1000, 64))])
def test_pages_whatever_the_keys(spark, scratch, monkeypatch, docs, groups):
    """Ids that come twice, below zero, far apart or not at all, on both sides; items of a page never come in two parts."""
    monkeypatch.setattr(views, "GROUP_DOCS", groups[0])
    monkeypatch.setattr(views, "GROUP_LAPS", groups[1])
    ids = [*range(-450, 900), *[5] * 7, 2**63 - 1, 2 - 2**63, 2**53 + 1, 10**12 + 3, None, None]
    docs = [(i, [None, "", f"text {i}"][min(i, 2)]) for i in range(docs)]
    docs += [(3, "again"), (4, None), (None, "no id"), (-2, "minus")] if docs else []
    kinds = _events_and_docs(spark, scratch, ids, docs)
    want = {}
    for i, kind in zip(ids, kinds):
        key = i if i is None or not docs else (abs(i) % len(docs)) * (1 if i >= 0 else -1)
        for doc, text in docs:
            if i is not None and doc == key:
                want.setdefault((kind, int(i / 200)), []).append((str(i), text, "superChatEvent" if kind == "error" else "textMessageEvent"))
    pages = views.chat_pages(spark, scratch).collect()
    assert len(pages) == len(want)
    for p in pages:
        got = [(x.id, x.snippet.textMessageDetails.messageText, x.snippet.type) for x in p["items"]]
        assert sorted(got, key=repr) == sorted(want[p.video_id, p.page_no], key=repr)


def test_pages_are_handed_on_some_at_a_time(monkeypatch):
    monkeypatch.setattr(views, "PAGE_BYTES_AT_ONCE", 1000)
    packed, rows = views.zlib.compress(b"x" * 300), []
    for block in range(3):
        rows += [(block, 0, False, 7, packed, *[None] * 8), (block, 0, False, 8, None, *[None] * 8)]
        rows += [(block, 0, True, 7 + i % 2, None, None if page == 2 else "v", 10 * block + page, f"{i}", "t", "a", "p", "n", "i")
                 for page in range(3) for i in range(5)]
        rows += [(block, 0, True, 9, None, "w", 0, "gone", "t", "a", "p", "n", "i")]          # its text is not among the documents
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.int64()] + [pa.string()] * 6
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], views._DEALT)
    out = list(views._pages(batch.slice(i, 4) for i in range(0, len(rows), 4)))
    pages = [p for b in out for p in b.to_pylist()]
    assert len(out) > 3 and [p["page_no"] for p in pages] == [10 * b + p for b in range(3) for p in range(3)]
    texts = [i["snippet"]["textMessageDetails"]["messageText"] for i in pages[0]["items"]]
    assert all(len(p["items"]) == 5 for p in pages) and texts == [b"x" * 300, None, b"x" * 300, None, b"x" * 300]


def test_runs_are_joined_across_buckets_without_a_sort_of_a_partition(spark):
    rng = random.Random(5)
    rows = []
    for part in (0, 1, None):
        for _ in range(300):
            lo = rng.randrange(40 * O.BUCKET)
            rows.append((part, lo, lo + rng.choice([0, 0, 1, 5, 100, O.BUCKET - 1, 3 * O.BUCKET if rng.random() < 0.05 else 2])))
        for b in range(1, 6):                                      # runs that meet at the border of a bucket, and one that covers others
            rows += [(part, b * O.BUCKET - 3, b * O.BUCKET - 1), (part, b * O.BUCKET, b * O.BUCKET + 2)]
    rows += [(2, i, i) for i in range(0, 4000, 2)] + [(2, 10, 3 * O.BUCKET), (3, 7, 7)]
    want = []
    for part in {r[0] for r in rows}:
        out = []
        for _, lo, hi in sorted((r for r in rows if r[0] == part), key=lambda r: r[1:]):
            if out and lo <= out[-1][2] + 1:
                out[-1][2] = max(out[-1][2], hi)
            else:
                out.append([part, lo, hi])
        want += map(tuple, out)
    frame = spark.createDataFrame(rows, "partition long, lo long, hi long").repartition(5)
    merged = O.merge_runs(frame)
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(want, key=str)
    # windows over a whole partition see one row per bucket, not the runs
    windows = [line for line in _plan(merged).splitlines() if "Window [" in line and "windowspecdefinition(partition" in line]
    over_runs = [line for line in windows if "__bucket" not in line and ("lo#" in line or "hi#" in line)]
    assert windows and not over_runs
