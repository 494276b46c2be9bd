"""Leaderboards kept incrementally by a stateful streaming query.

Spark's state store keeps the running toxic count of every (video, author): a
streaming aggregate in update mode, so each micro-batch yields only the authors
whose total changed, and the state is spread over the shuffle partitions by
(video, author) — a hot video's authors are not held by one task.

Counts only grow, so the new top ``k`` of a video is the top ``k`` of its
previous board plus the authors updated in this batch: every other author was
behind all ``k`` board members before and still is (their totals did not fall,
ties keep breaking on author id). A micro-batch therefore reads its updated
authors and ``k`` board rows per updated video, never the video's history,
however hot the video is. Boards are written only when they change, as
``(stream_id, batch_id)`` partitions of the ``boards`` table (a replayed batch
rewrites its own partition); the rows of a board carry its string form, so the
change feed is a projection of the table. ``PartialStore.compact("boards", k)``
keeps the latest board per video and retires older partitions like the other
tables.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatmod import schema as S
from chatmod.operators.leaderboard import board_string
from chatmod.operators.merge import present
from chatmod.operators.serving import leader_order, top_k_per_video
from chatmod.session import bounded_broadcast
from chatmod.streaming.store import PartialStore

BOARDS = "boards"
TOUCHED_VIDEOS_BROADCAST_ROWS = 100_000


def toxic_totals(scored: DataFrame, threshold: float = S.USER_TOXIC_THRESHOLD) -> DataFrame:
    """Running toxic comment count per (video, author) — the sum over windows of the
    author metric's ``toxic_count``. On a stream, run it in update mode."""
    return (scored.where((F.col("toxic_score") >= threshold) & present("video_id", "author_id"))
                  .groupBy("video_id", "author_id")
                  .agg(F.count(F.lit(1)).cast("long").alias("toxic_count")))


def _board_strings(top: DataFrame) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("rank", board_string(F.col("author_id"), F.col("toxic_count"))
                                                    .alias("t"))))
    return top.groupBy("video_id").agg(F.array_join(F.transform(entries, lambda x: x["t"]), ",").alias("leaderboard"))


def previous_boards(store: PartialStore, videos: DataFrame, stream_id: str, batch_id: int,
                    table: str = BOARDS) -> DataFrame | None:
    """Latest board rows (video_id, rank, author_id, toxic_count, leaderboard) of the
    given videos written by this stream before ``batch_id``; None before the first."""
    rows = store.partials(table)                # latest snapshot (if compacted) + newer partials
    if rows is None:
        return None
    touched = bounded_broadcast(videos.select("video_id").distinct(), TOUCHED_VIDEOS_BROADCAST_ROWS)
    rows = (rows.where((F.col("stream_id") == stream_id) & (F.col("batch_id") < batch_id))
                .join(touched, on="video_id", how="left_semi"))
    latest = rows.groupBy("video_id").agg(F.max("batch_id").alias("batch_id"))
    return (rows.join(latest, on=["video_id", "batch_id"], how="left_semi")
                .select("video_id", "rank", "author_id", "toxic_count", "leaderboard"))


def update_boards(updated: DataFrame, batch_id: int, store: PartialStore, stream_id: str | None = None,
                  k: int = S.LEADERBOARD_SIZE, table: str = BOARDS) -> None:
    """``foreachBatch`` body: ``updated`` holds the new totals (video_id, author_id,
    toxic_count) of the authors this batch changed; write the boards that changed."""
    spark = updated.sparkSession
    if stream_id is None:
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    # Cut the lineage to the stateful operator: the changed totals are written once
    # (one folder per stream, overwritten by every batch, so a replay rewrites it)
    # and read back, so a lost executor never re-runs the state update mid-batch.
    staged = f"{store.path(table)}__changed/{re.sub(r'[^A-Za-z0-9_.-]', '_', stream_id)}"
    updated.select("video_id", "author_id", "toxic_count").write.mode("overwrite").parquet(staged)
    updated = spark.read.parquet(staged).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if updated.isEmpty():
            return
        prev = previous_boards(store, updated, stream_id, batch_id, table)
        cand = updated
        if prev is not None:
            kept = prev.select("video_id", "author_id", "toxic_count").join(
                updated.select("video_id", "author_id"), on=["video_id", "author_id"], how="left_anti")
            cand = kept.unionByName(updated)
        top = top_k_per_video(cand, k, leader_order())
        boards = _board_strings(top)
        if prev is not None:
            before = prev.select("video_id", F.col("leaderboard").alias("previous")).distinct()
            boards = (boards.join(before, on="video_id", how="left")
                            .where(F.col("previous").isNull() | (F.col("previous") != F.col("leaderboard")))
                            .drop("previous"))
        changed = top.join(boards, on="video_id", how="inner")
        store.write(changed.select("video_id", "rank", "author_id", "toxic_count", "leaderboard"),
                    table, stream_id, batch_id)
    finally:
        updated.unpersist()


def current_boards(store: PartialStore, stream_id: str, video_id: str | None = None,
                   table: str = BOARDS) -> DataFrame | None:
    """The latest board of each video (or one video) as maintained by the stream:
    rows (video_id, rank, author_id, toxic_count) — the leaderboard part of a
    dashboard snapshot, read from at most k rows per video instead of being
    recomputed from the author metrics. None before the first board."""
    rows = store.partials(table)
    if rows is None:
        return None
    rows = rows.where(F.col("stream_id") == stream_id)
    if video_id is not None:
        rows = rows.where(F.col("video_id") == video_id)
    latest = rows.groupBy("video_id").agg(F.max("batch_id").alias("batch_id"))
    return (rows.join(latest, on=["video_id", "batch_id"], how="left_semi")
                .select("video_id", "rank", "author_id", "toxic_count"))


def board_changes(store: PartialStore, stream_id: str | None = None, table: str = BOARDS) -> DataFrame:
    """The change feed: one row per (stream, batch, video) whose board changed."""
    rows = store.raw(table)
    if rows is None:                             # nothing written yet, or all retired
        return store.spark.createDataFrame([], "stream_id string, batch_id long, video_id string, leaderboard string")
    if stream_id is not None:
        rows = rows.where(F.col("stream_id") == stream_id)
    return rows.select("stream_id", "batch_id", "video_id", "leaderboard").distinct()


def start_leaderboard_stream(spark: SparkSession, scored: DataFrame, store: PartialStore | None = None,
                             checkpoint: str | None = None, trigger: dict | None = None,
                             k: int = S.LEADERBOARD_SIZE, query_name: str | None = None) -> StreamingQuery:
    """Run the leaderboards as their own query over a scored comment stream
    (``transform_comments(decode_comments(read_comment_stream(...)))``)."""
    store = store or PartialStore(spark)
    checkpoint = checkpoint or f"{store.root}/_checkpoints/{query_name or 'leaderboards'}"
    writer = (toxic_totals(scored).writeStream
              .outputMode("update")
              .foreachBatch(lambda df, bid: update_boards(df, bid, store, k=k))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(**(trigger or {"processingTime": S.TRIGGER_INTERVAL}))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()
