"""Dashboard questions over the merged tables, for one video or all videos at once.

Top-k answers use ``orderBy().limit()`` (planned as a per-partition top-k plus
a k-row merge) or ``row_number() <= k`` per video (planned with a map-side
``WindowGroupLimit``, so a hot video ships k rows per task, not all its rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.functions.display import author_initials, null_to_zero, time_label


def _for_video(df: DataFrame, video_id: str | None) -> DataFrame:
    return df if video_id is None else df.where(F.col("video_id") == video_id)


def top_k_per_video(df: DataFrame, k: int, order: list[Column], partition: str = "video_id",
                    rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# -- comments ---------------------------------------------------------------

def _present(df: DataFrame, fields: list[str], carry: Sequence[str]) -> list[str]:
    """``fields`` the input has (a caller may attach ``message`` after the top-k), plus ``carry``."""
    return [c for c in fields if c in df.columns] + list(carry)


def latest_comments(comments: DataFrame, video_id: str | None, k: int = S.LATEST_COMMENTS_LIMIT,
                    carry: Sequence[str] = ()) -> DataFrame:
    """Newest ``k`` comments of a video by publish time (served fields only).

    ``carry``: extra columns kept through the top-k, e.g. a document key to
    attach the whole message text to the ``k`` survivors only."""
    order = [F.col("published_at").desc(), F.col("comment_id").desc()]
    cols = _present(comments, S.SERVED_COMMENT_FIELDS, carry)
    if video_id is None:
        return top_k_per_video(comments, k, order).select("video_id", *cols)
    return _for_video(comments, video_id).orderBy(*order).limit(k).select(*cols)


def rolling_feed(rows: DataFrame, video_id: str | None, k: int = S.LATEST_COMMENTS_LIMIT,
                 carry: Sequence[str] = ()) -> DataFrame:
    """Feed after pushing every batch: newer batches in front of older ones, first ``k`` kept.

    ``rows`` are the pushed rows (``FEED_FIELDS`` + ``batch_id``); held rows and new
    rows are one bag (union), ordered by batch, then publish time, newest first.
    """
    order = [F.col("batch_id").desc(), F.col("published_at").desc(), F.col("comment_id").desc()]
    cols = _present(rows, [*S.FEED_FIELDS, "batch_id"], carry)
    if video_id is None:
        return top_k_per_video(rows, k, order, rank_col="position").select(*cols, "position")
    return _for_video(rows, video_id).orderBy(*order).limit(k).select(*cols)


def push_to_feed(new_rows: DataFrame, held: DataFrame, k: int = S.LATEST_COMMENTS_LIMIT,
                 carry: Sequence[str] = ()) -> DataFrame:
    """One feed step: new rows before held rows, keep the first ``k`` per video."""
    return rolling_feed(new_rows.unionByName(held), None, k, carry)


def feed_view(rows: DataFrame) -> DataFrame:
    """Feed rows as displayed: category / action only on toxic rows, initials when
    there is no avatar, ``HH:mm`` time label."""
    toxic = F.col("toxic_label") == S.LABEL_TOXIC
    return rows.select(
        *S.FEED_FIELDS[:7],
        "toxic_label",
        F.when(toxic, F.col("toxic_category")).alias("toxic_category"),
        F.when(toxic, F.col("recommended_action")).alias("recommended_action"),
        toxic.alias("is_toxic"),
        author_initials(F.col("author_name"), F.col("author_image")).alias("avatar_text"),
        time_label(F.col("published_at")).alias("time_label"),
    )


def feed_count(feed: DataFrame) -> DataFrame:
    """Messages shown per video."""
    return feed.groupBy("video_id").agg(F.count(F.lit(1)).alias("messages"))


# -- metrics ----------------------------------------------------------------

def _served_metric(df: DataFrame) -> DataFrame:
    return df.select("video_id", "window_start", "total_comments",
                     null_to_zero(F.col("toxic_count")).alias("toxic_count"),
                     "toxic_ratio",
                     null_to_zero(F.col("unique_viewers")).alias("unique_viewers"))


def recent_windows(metrics: DataFrame, video_id: str | None, k: int = S.RECENT_WINDOWS_LIMIT) -> DataFrame:
    """Latest ``k`` windows of a video, returned oldest first."""
    if video_id is None:
        latest = top_k_per_video(metrics, k, [F.col("window_start").desc()]).drop("rank")
    else:
        latest = _for_video(metrics, video_id).orderBy(F.col("window_start").desc()).limit(k)
    return _served_metric(latest).orderBy("video_id", "window_start")


def upsert_recent_windows(updates: DataFrame, video_id: str | None, k: int = S.RECENT_WINDOWS_LIMIT) -> DataFrame:
    """Apply metric change events in order: last event per window wins, keep the latest ``k`` windows."""
    last = (updates.groupBy("video_id", "window_start")
                   .agg(F.max_by(F.struct("total_comments", "toxic_count", "unique_viewers"), "batch_id").alias("m"))
                   .select("video_id", "window_start", "m.*"))
    if video_id is None:
        latest = top_k_per_video(last, k, [F.col("window_start").desc()]).drop("rank")
    else:
        latest = _for_video(last, video_id).orderBy(F.col("window_start").desc()).limit(k)
    return latest.select("video_id", "window_start", "total_comments",
                         null_to_zero(F.col("toxic_count")).alias("toxic_count"),
                         null_to_zero(F.col("unique_viewers")).alias("unique_viewers")
                         ).orderBy("video_id", "window_start")


# -- authors / leaderboard --------------------------------------------------

def leader_order() -> list[Column]:
    return [F.col("toxic_count").desc(), F.col("author_id").asc()]


def author_totals(user_metrics: DataFrame) -> DataFrame:
    """Toxic count per (video, author) over all windows; name / image = max (deterministic)."""
    return (user_metrics.groupBy("video_id", "author_id")
            .agg(F.max("author_name").alias("author_name"),
                 F.max("author_image").alias("author_image"),
                 F.sum("toxic_count").cast("long").alias("toxic_count")))


def top_authors(totals: DataFrame, video_id: str, k: int = S.LEADERBOARD_SIZE) -> DataFrame:
    """Top ``k`` toxic authors of one video (ties: author id ascending)."""
    return (_for_video(totals, video_id).orderBy(*leader_order()).limit(k)
            .select("author_id", "author_name", "author_image", "toxic_count"))


def top_authors_all(totals: DataFrame, k: int = S.LEADERBOARD_SIZE) -> DataFrame:
    """Top ``k`` per video for every video, with the rank."""
    return (top_k_per_video(totals, k, leader_order())
            .select("video_id", "rank", "author_id", "author_name", "author_image", "toxic_count"))


def leaderboard_view(top: DataFrame) -> DataFrame:
    """Rank label and share of the leader (percent, capped at 100; leader 0 → divisor 1)."""
    leader = F.max("toxic_count").over(Window.partitionBy("video_id"))
    share = F.least(F.col("toxic_count") / F.coalesce(F.nullif(leader, F.lit(0)), F.lit(1)) * 100, F.lit(100.0))
    return top.select("video_id", "rank", F.concat(F.lit("#"), F.col("rank")).alias("rank_label"),
                      "author_id", "author_name", "toxic_count", share.alias("share_pct"))


def author_lookup(rows: DataFrame, order_col: str = "kafka_timestamp") -> DataFrame:
    """Global author → (name, avatar), last write wins."""
    return (rows.groupBy("author_id")
            .agg(F.max_by(F.struct(F.col("author_name").alias("name"),
                                   F.col("author_image").alias("avatar")), order_col).alias("a"))
            .select("author_id", "a.name", "a.avatar"))


def enrich_leaderboard(board: DataFrame, authors: DataFrame) -> DataFrame:
    """Leaderboard rows with name / avatar from the lookup; missing or empty values
    take ``Unknown`` / empty string."""
    b = board.drop("author_name", "author_image")
    j = b.join(authors.select("author_id", "name", "avatar"), on="author_id", how="left")
    return j.select(
        "video_id", "rank", "author_id",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(S.UNKNOWN_AUTHOR_NAME)).alias("author_name"),
        F.coalesce(F.nullif(F.col("avatar"), F.lit("")), F.lit(S.UNKNOWN_AUTHOR_IMAGE)).alias("author_image"),
        "toxic_count",
    )


# -- crawler status log -------------------------------------------------------

def latest_status(log: DataFrame, lookback: int = S.STATUS_LOOKBACK) -> DataFrame:
    """Latest status per video among the newest ``lookback`` log events."""
    newest = log.orderBy(F.col("seq").desc()).limit(lookback)
    return (newest.groupBy("video_id")
            .agg(F.max_by(F.struct("seq", "type", "live_chat_id"), "seq").alias("s"))
            .select("video_id", "s.type", "s.live_chat_id", "s.seq"))


def trim_log(log: DataFrame, capacity: int = S.STATUS_LOG_CAPACITY) -> DataFrame:
    """The bounded log: newest ``capacity`` events (a distributed top-k, no global window)."""
    return log.orderBy(F.col("seq").desc()).limit(capacity)
