"""Canonical inputs derived from the driver's tables (``events`` + ``documents``).

The comment stream is modelled on ``events``: one event = one chat comment on
video ``event_type`` by author ``user_id``, arriving at ``ts``; its message is
the whole text of document ``event_id % n`` over all ``n`` documents (doc ids
run 0 .. n - 1), so every document is used and message work grows with both
tables. ``toxic_score`` and the five label scores are derived from integers
(``value``), so Spark and SQL engines agree exactly on thresholds.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmod import schema as S
from chatmod.functions.policy import apply_policy, top_label
from chatmod.session import spread_for_cpu

LABEL_MULTIPLIERS = [1, 3, 7, 11, 13]  # label scores ((v * m) % 1001) / 1000, label order
BATCHES = 7                        # simulated micro-batch id = event_id % 7
REPLAY_BATCH_OFFSET = BATCHES      # a full topic replay lands in batches 7 .. 13
REPLAY_DELAY_HOURS = 1             # and arrives one hour later


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _v() -> Column:
    return F.round(F.col("value") * 100).cast("long")


def _label_score(m: int) -> Column:
    return ((_v() * m) % 1001) / F.lit(1000.0)


def comment_columns() -> list[Column]:
    return [
        F.col("event_id").cast("string").alias("comment_id"),
        F.col("event_type").alias("video_id"),
        F.col("user_id").cast("string").alias("author_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author_name"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("https://img.example/"), F.col("user_id").cast("string")))
         .otherwise(F.lit("")).alias("author_image"),
        (F.col("ts") - F.make_dt_interval(secs=(F.col("event_id") % 90).cast("decimal(18,6)"))).alias("published_at"),
        F.col("ts").alias("kafka_timestamp"),
        _label_score(1).alias("toxic_score"),
        (F.col("event_id") % BATCHES).alias("batch_id"),
    ]


def doc_count(spark: SparkSession, sf_dir: str) -> Column:
    """Number of documents, as a scalar subquery (planned once, no driver round trip)."""
    return table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()


def message_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message (doc_key, message).

    No broadcast hint: the documents grow with the data, so the join strategy
    comes from sizes — a shuffle join on ``doc_key`` (uniform: event ids modulo
    the document count) unless the planner's estimate or AQE's measured shuffle
    output puts one side under the broadcast threshold."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.col("text").alias("message"))


def doc_key(spark: SparkSession, sf_dir: str) -> Column:
    return (F.col("event_id") % doc_count(spark, sf_dir)).alias("doc_key")


def comments(spark: SparkSession, sf_dir: str, with_message: bool = True, extra: list[Column] | None = None) -> DataFrame:
    """Raw comments with a score. Without the message, no join is planned."""
    ev = table(spark, sf_dir, "events")
    cols = comment_columns() + list(extra or [])
    if not with_message:
        return ev.select(*cols)
    base = spread_for_cpu(ev.select(*cols, doc_key(spark, sf_dir)))
    return attach_message(spark, sf_dir, base)


def attach_message(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Join the message text onto rows carrying ``doc_key`` (late materialisation:
    shuffles upstream move the 8-byte key, not the whole text). The documents may
    end up as the streamed side of the join, so a small single-file document
    table is spread over the cores (a no-op on large inputs)."""
    docs = spread_for_cpu(message_docs(spark, sf_dir))
    return df.join(docs, on="doc_key", how="inner").drop("doc_key")


def predictions_from_value() -> Column:
    return F.struct(*[_label_score(m).alias(l) for m, l in zip(LABEL_MULTIPLIERS, S.LABELS)])


def scored_comments(spark: SparkSession, sf_dir: str, with_message: bool = True,
                    extra: list[Column] | None = None) -> DataFrame:
    """Comments after the scoring step: five label scores, then top label and policy."""
    base = comments(spark, sf_dir, with_message, extra=[predictions_from_value().alias("predictions")] + list(extra or []))
    return apply_policy(top_label(base.drop("toxic_score"), "predictions"))


def _redelivery() -> dict[str, Column]:
    """Columns that differ when a consumer restarted from the earliest offset."""
    return {"batch_id": F.col("batch_id") + REPLAY_BATCH_OFFSET,
            "kafka_timestamp": F.col("kafka_timestamp") + F.make_dt_interval(hours=F.lit(REPLAY_DELAY_HOURS))}


def replayed(rows: DataFrame) -> DataFrame:
    """The same rows redelivered by a consumer that restarted from the earliest offset."""
    return rows.withColumns(_redelivery())


def with_replay(rows: DataFrame) -> DataFrame:
    """``rows`` plus their redelivery (``replayed``), both made from one read: each
    row yields its two deliveries through a generator, so the input is scanned
    once instead of once per side of a union."""
    changed = _redelivery()
    first = F.struct(*[F.col(c) for c in rows.columns])
    second = F.struct(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns])
    return rows.select(F.explode(F.array(first, second)).alias("d")).select("d.*")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as topic records: JSON payload (camelCase), key = video, offsets = event ids."""
    c = comments(spark, sf_dir).withColumn("published_at", iso(F.col("published_at")))
    payload = F.to_json(F.struct(
        F.lit(S.MESSAGE_TYPE_CHAT).alias("type"),
        F.col("comment_id").alias("commentId"),
        F.col("video_id").alias("videoId"),
        F.col("message").alias("message"),
        F.col("author_id").alias("authorId"),
        F.col("author_image").alias("authorImage"),
        F.col("author_name").alias("authorName"),
        F.col("published_at").alias("publishedAt"),
    ))
    return c.select(
        F.col("video_id").alias("key"),
        payload.alias("value"),
        F.lit(S.TOPIC).alias("topic"),
        (F.length("video_id") % 3).cast("int").alias("partition"),
        F.col("comment_id").cast("long").alias("offset"),
        F.col("kafka_timestamp").alias("timestamp"),
    )


BAD_CYCLE = 11   # of this many consecutive events, the first seven arrive damaged, each in its own way


def damaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``topic_records`` as a careless producer sends them. By event id modulo ``BAD_CYCLE``: 0 JSON cut off,
    1 no comment id (nor message), 2 no value at all, 3 no message, 4 no video, 5 an empty video, 6 a malformed time."""
    c = comments(spark, sf_dir).withColumn("published_at", iso(F.col("published_at")))
    kind = F.col("comment_id").cast("long") % BAD_CYCLE
    payload = F.to_json(F.struct(
        F.lit(S.MESSAGE_TYPE_CHAT).alias("type"),
        F.when(kind != 1, F.col("comment_id")).alias("commentId"),
        F.when(kind == 5, "").when(kind != 4, F.col("video_id")).alias("videoId"),
        F.when(~kind.isin(1, 3), F.col("message")).alias("message"),
        F.col("author_id").alias("authorId"),
        F.col("author_image").alias("authorImage"),
        F.col("author_name").alias("authorName"),
        F.when(kind == 6, "bad").otherwise(F.col("published_at")).alias("publishedAt"),
    ))
    cut_off = F.concat(F.lit('{"commentId":"'), F.col("comment_id"), F.lit('"'))
    return c.select(
        F.col("video_id").alias("key"),
        F.when(kind == 0, cut_off).when(kind != 2, payload).alias("value"),
        F.lit(S.TOPIC).alias("topic"),
        (F.length("video_id") % 3).cast("int").alias("partition"),
        F.col("comment_id").cast("long").alias("offset"),
        F.col("kafka_timestamp").alias("timestamp"),
    )


PAGE_SIZE = 200  # items per chat page (pages never grow with the data)
GROUP_DOCS, GROUP_LAPS = 1000, 64     # document numbers, and rounds over all documents, whose pages are made in one task
PAGE_BYTES_AT_ONCE = 4 * 1024 * 1024  # pages are handed on when they hold so much, each item with its text and
ITEM_BYTES = 200                      # so much for its other fields


@F.arrow_udf(T.BinaryType())
def _packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([t if t is None else zlib.compress(t) for t in batch.to_pylist()], pa.binary())


_PAGE = ("video_id string, page_no long, items array<struct<id: string, snippet: struct<type: string, authorChannelId: string, "
         "publishedAt: string, textMessageDetails: struct<messageText: {text}>>, "
         "authorDetails: struct<displayName: string, profileImageUrl: string>>>")
_DEALT = ["block", "lap", "is_item", "doc_key", "message", "video_id", "page_no", "comment_id", "type", "author_id",
          "published_at", "author_name", "author_image"]      # columns of the rows that _pages reads, in order


def _page_batch(keys: list[tuple], starts: list[int], items: list[tuple]) -> pa.RecordBatch:
    """Pages (video, page number), each with the items from its start to the next one's."""
    text, *strings = zip(*items)
    comment, kind, author, published, name, image = (pa.array(c, pa.string()) for c in strings)
    details = pa.StructArray.from_arrays([pa.array(text, pa.binary())], ["messageText"])
    snippet = pa.StructArray.from_arrays([kind, author, published, details],
                                         ["type", "authorChannelId", "publishedAt", "textMessageDetails"])
    shown = pa.StructArray.from_arrays([name, image], ["displayName", "profileImageUrl"])
    items = pa.StructArray.from_arrays([comment, snippet, shown], ["id", "snippet", "authorDetails"])
    video, page = zip(*keys)
    lists = pa.ListArray.from_arrays(pa.array([*starts, len(items)], pa.int32()), items)
    return pa.RecordBatch.from_arrays([pa.array(video, pa.string()), pa.array(page, pa.int64()), lists],
                                      ["video_id", "page_no", "items"])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of each group of rows, whose texts come first, unpacked once, and then its items page by page."""
    group, texts = None, {}
    keys, starts, items, size = [], [], [], 0
    for batch in batches:
        for block, lap, is_item, doc, text, video, page, *item in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, lap) != group:
                group, texts = (block, lap), {}
            if not is_item:
                texts.setdefault(doc, []).append(text if text is None else zlib.decompress(text))
                continue
            for text in texts.get(doc, ()):
                if not keys or keys[-1] != (video, page):
                    if size > PAGE_BYTES_AT_ONCE:
                        yield _page_batch(keys, starts, items)
                        keys, starts, items, size = [], [], [], 0
                    keys.append((video, page))
                    starts.append(len(items))
                items.append((text, *item))
                size += ITEM_BYTES + len(text or b"")
    if keys:
        yield _page_batch(keys, starts, items)


def chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed into chat API pages of ≤ 200 consecutive events per video;
    ``error`` events arrive as a non-text item type.

    Every message text has to travel to its page, and a text goes to as many pages
    as it has events. So pages that share texts are put together in one task: those
    whose first event points into the same ``GROUP_DOCS`` document numbers, at most
    ``GROUP_LAPS`` rounds over the documents together. A text then moves once for each
    group that shows it, compressed, and a page's events, which point to neighbouring
    documents, move without texts. Which texts a group needs is read from its events:
    wherever they point, no text moves more often than it has events."""
    n = F.nullif(doc_count(spark, sf_dir), F.lit(0))        # of no documents there are no pages
    page = (F.col("comment_id").cast("long") / PAGE_SIZE).cast("long")
    first = (F.col("page_no") % n) * PAGE_SIZE % n
    kind = F.when(F.col("video_id") == "error", F.lit("superChatEvent")).otherwise(F.lit(S.TEXT_MESSAGE_EVENT))
    events = (comments(spark, sf_dir, with_message=False, extra=[(F.col("event_id") % n).alias("doc_key")])
              .where(F.col("doc_key").isNotNull()).withColumn("page_no", page)
              .withColumns({"block": (first / GROUP_DOCS).cast("long"),
                            "lap": (F.col("page_no") / (F.greatest(n / PAGE_SIZE, F.lit(1)) * GROUP_LAPS)).cast("long")}))
    docs = spread_for_cpu(message_docs(spark, sf_dir)).withColumn("message", _packed(F.col("message").cast("binary")))
    texts = events.select("block", "lap", "doc_key").distinct().join(docs, on="doc_key", how="inner")
    items = events.select("block", "lap", "doc_key", "video_id", "page_no", "comment_id", "author_id", "published_at",
                          "author_name", "author_image")
    dealt = (texts.withColumn("is_item", F.lit(False))
             .unionByName(items.withColumn("is_item", F.lit(True)), allowMissingColumns=True)
             .repartition("block", "lap").sortWithinPartitions("block", "lap", "is_item", "video_id", "page_no"))
    rows = dealt.withColumns({"type": kind, "published_at": iso(F.col("published_at"))}).select(*_DEALT)
    text = _PAGE.format(text="string").split("items ")[1]
    return rows.mapInArrow(_pages, _PAGE.format(text="binary")).withColumn("items", F.col("items").cast(text))


DECOMPOSED = "àáâäçèéêëíîïñóôöùúûüÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"    # letters of the test languages that have a decomposed form


def decomposed(text: Column) -> Column:
    """The text with these letters written as base letter and combining mark."""
    out = text
    for letter in DECOMPOSED:
        out = F.replace(out, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(out)      # ASCII text has none of them


def without_some_videos(rows: DataFrame) -> DataFrame:
    """Comments of which every fifth lost its video id."""
    return rows.withColumn("video_id", F.when(F.col("comment_id").cast("long") % 5 != 0, F.col("video_id")))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawler status log modelled on events: video = user id, status = event type, seq = event id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"),
                     F.concat(F.lit("chat_"), F.col("user_id").cast("string")).alias("live_chat_id"),
                     F.col("user_id").cast("string").alias("video_id"))


def published_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO publish-time strings as they arrive on the topic; ``error`` events carry a malformed one."""
    c = comments(spark, sf_dir, with_message=False)
    return c.select("comment_id",
                    F.when(F.col("video_id") == "error", F.lit("bad")).otherwise(iso(F.col("published_at")))
                     .alias("published_at"))


VIDEO_URL_FORMS = ["https://www.youtube.com/watch?v={}", "https://youtu.be/{}", "https://www.youtube.com/shorts/{}",
                   "https://www.youtube.com/embed/{}", "https://www.youtube.com/watch?v={}&t=1s"]


def video_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL per event: watch / short link / shorts / embed / watch with parameters,
    built on an 11-character id; ``error`` events carry a truncated (invalid) id."""
    ev = table(spark, sf_dir, "events")
    vid = F.lpad(F.col("event_id").cast("string"), 11, "0")
    vid = F.when(F.col("event_type") == "error", F.substring(vid, 1, 10)).otherwise(vid)
    form = F.col("event_id") % len(VIDEO_URL_FORMS)
    url = None
    for i, f in enumerate(VIDEO_URL_FORMS):
        pre, post = f.split("{}")
        u = F.concat(F.lit(pre), vid, F.lit(post))
        url = F.when(form == i, u) if url is None else url.when(form == i, u)
    return ev.select(F.col("event_id"), url.alias("url"))
