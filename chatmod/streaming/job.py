"""The streaming job: topic → decode → clean → score → policy → three tables.

``start_stream`` runs one Structured Streaming query whose ``foreachBatch``
persists the scored micro-batch once and writes the comment partial, the
per-minute channel partial and the per-minute author partial, each to its own
``(stream_id, batch_id)`` partition. A failure fails the batch (no silent
loss); the retry from the checkpoint rewrites the same partitions.

``native_stream_metric`` is the alternative that keeps state inside Spark
(watermark + windowed aggregate, update mode). It drops rows later than the
watermark, which the partial design never does.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.util import inheritable_thread_target

from chatmod import schema as S
from chatmod.functions.policy import apply_policy, top_label
from chatmod.functions.scoring import LexiconScorer, Scorer
from chatmod.functions.text import clean_messages
from chatmod.operators.merge import first_delivery
from chatmod.operators.metrics import stream_metric_partials, user_metric_partials
from chatmod.sources.topic import comment_rejects, decode_comments, parse_published_at
from chatmod.session import spread_for_cpu
from chatmod.streaming.store import PartialStore

COMMENT_COLUMNS = [
    "comment_id", "video_id", "message", "author_id", "author_image", "author_name", "published_at",
    "kafka_timestamp", "offset", "partition", "toxic_score", "toxic_category", "toxic_label", "recommended_action",
]


def transform_comments(raw: DataFrame, scorer: Scorer | None = None, normalize: bool = True) -> DataFrame:
    """Decoded comments → scored comments (works on batch and streaming input).

    ``normalize=False`` skips the NFC UDF, e.g. when the scorer is a
    ``ModelScorer(normalize=True)`` that normalises inside its own Python hop.
    """
    scorer = scorer or LexiconScorer()
    df = parse_published_at(raw)
    df = clean_messages(df, "message", "message_clean", normalize=normalize)
    df = scorer.score(df, "message_clean", "predictions")
    df = apply_policy(top_label(df, "predictions"))
    return df.drop("message_clean")


def process_batch(batch: DataFrame, batch_id: int, store: PartialStore, stream_id: str | None = None,
                  window: str = S.METRIC_WINDOW, dedup_within_batch: bool = False,
                  leaderboards: bool = False) -> None:
    """Write one micro-batch's partials (comments → channel metrics → author metrics),
    then, with ``leaderboards=True``, the leaderboards this batch changed.

    By default a comment delivered twice in a batch is counted twice, as the
    original sink does; ``dedup_within_batch=True`` keeps each comment's earliest
    delivery (by topic time, then offset) — a deterministic choice, so a retried
    batch keeps the same copy. With a ``VersionedStore``, offsets that any stream has
    committed are left out, and the tables change together when the batch commits."""
    if stream_id is None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    writer = store.begin(stream_id, batch_id)
    if writer is None:                           # committed before the stream's checkpoint was
        return
    batch = writer.fresh(batch)
    if dedup_within_batch:
        order = [c for c in ("kafka_timestamp", "offset") if c in batch.columns]
        batch = first_delivery(batch, "comment_id", order)
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cols = [c for c in COMMENT_COLUMNS if c in batch.columns]
        # the comment write fills the cache; the two metric writes then read the
        # cached batch and run as concurrent jobs (small, latency-bound)
        writer.write(batch.select(*cols), "comments", stream_id, batch_id)
        only_toxic = writer.user_filter_scope == "batch"
        # the writer threads inherit this thread's job properties (the query's job
        # group among them), so stopping the query cancels their jobs too
        write = inheritable_thread_target(batch.sparkSession)(writer.write)
        with ThreadPoolExecutor(max_workers=2) as pool:
            jobs = [pool.submit(write, stream_metric_partials(batch, window, sketch=True), "stream_metric",
                                stream_id, batch_id),
                    pool.submit(write, user_metric_partials(batch, window, only_toxic=only_toxic), "user_metric",
                                stream_id, batch_id)]
            for job in jobs:
                job.result()                     # a failed write fails the batch
        if leaderboards:
            from chatmod.streaming.sinks import emit_leaderboard_changes
            emit_leaderboard_changes(writer, batch, stream_id, batch_id)
        writer.record(batch)
        writer.commit()
    finally:
        batch.unpersist()


def start_stream(spark: SparkSession, records: DataFrame, store: PartialStore | None = None,
                 checkpoint: str | None = None, trigger: dict | None = None, scorer: Scorer | None = None,
                 window: str = S.METRIC_WINDOW, query_name: str | None = None,
                 leaderboards: bool = False, dedup_within_batch: bool = False) -> StreamingQuery:
    """Start the comment stream. ``records`` is a streaming topic DataFrame
    (``read_comment_stream``); ``trigger`` defaults to a 10-second processing-time trigger."""
    store = store or PartialStore(spark)
    checkpoint = checkpoint or f"{store.root}/_checkpoints/{query_name or 'comments'}"

    def run(batch: DataFrame, batch_id: int) -> None:
        # Decode and score inside the batch: the micro-batch is a static DataFrame
        # here, so a batch read by fewer tasks than cores (one file per trigger, a
        # topic with few partitions) is spread before the whole-text work.
        scored = transform_comments(decode_comments(spread_for_cpu(batch), stamp_processing_time=True), scorer)
        process_batch(scored, batch_id, store, window=window, leaderboards=leaderboards,
                      dedup_within_batch=dedup_within_batch)

    writer = (records.writeStream
              .foreachBatch(run)
              .option("checkpointLocation", checkpoint)
              .outputMode("append"))
    writer = writer.trigger(**(trigger or {"processingTime": S.TRIGGER_INTERVAL}))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def start_rejects_stream(spark: SparkSession, records: DataFrame, store: PartialStore | None = None,
                         checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Companion query: topic records that do not decode to a comment with an id,
    appended as they are to ``<store>/rejects`` (the main query drops them)."""
    store = store or PartialStore(spark)
    checkpoint = checkpoint or f"{store.root}/_checkpoints/rejects"
    writer = (comment_rejects(records).writeStream.format("parquet")
              .option("path", store.path("rejects"))
              .option("checkpointLocation", checkpoint)
              .outputMode("append"))
    return writer.trigger(**(trigger or {"processingTime": S.TRIGGER_INTERVAL})).start()


def native_stream_metric(scored: DataFrame, watermark: str = "10 minutes", window: str = S.METRIC_WINDOW,
                         ts_col: str = "kafka_timestamp") -> DataFrame:
    """Windowed channel metrics kept in Spark's state store (use with update mode)."""
    return (scored.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window).alias("window"), "video_id")
            .agg(F.count("comment_id").alias("total_comments"),
                 F.sum((F.col("toxic_score") > S.STREAM_TOXIC_THRESHOLD).cast("long")).alias("toxic_count"),
                 F.approx_count_distinct("author_id", S.APPROX_DISTINCT_RSD).alias("unique_viewers"))
            .select("video_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "total_comments", "toxic_count", "unique_viewers"))
