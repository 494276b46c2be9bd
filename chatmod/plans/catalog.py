"""Named queries over the driver tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
tables; nothing is collected here. Column names match the SQL in
``chatmod.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.functions.learned import fit as fit_ngrams
from chatmod.functions.policy import apply_policy, top_label
from chatmod.functions.scoring import LexiconScorer, ModelScorer, lexicon_model_loader, round_score, sigmoid
from chatmod.functions.text import clean_messages as _clean
from chatmod.functions.urls import extract_video_id
from chatmod.operators import file_index as I
from chatmod.operators import merge as M
from chatmod.operators import offsets as O
from chatmod.operators import serving as V
from chatmod.operators import viewer_ranges as R
from chatmod.operators.heavy_hitters import top_authors_two_pass
from chatmod.operators.leaderboard import leaderboard_changes as _changes
from chatmod.operators.metrics import (stream_metric_partials, unique_viewers, unique_viewers_merged as _uv_merged,
                                       user_metric_partials)
from chatmod.plans import views
from chatmod.session import shared_dir, spread_for_cpu
from chatmod.sources.change_feed import read_changes
from chatmod.sources.chat_pages import flatten_chat_pages as _flatten
from chatmod.sources.topic import comment_rejects
from chatmod.sources.topic import decode_comments as _decode
from chatmod.sources.topic import parse_published_at as _parse
from chatmod.sources.topic import snake_case_columns as _snake
from chatmod.sources.topic import to_keyed_messages as _keyed
from chatmod.streaming.job import process_batch, transform_comments
from chatmod.streaming.versions import VersionedStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ROWS_ONLY = set()          # queries whose result is approximate: no exact SQL equivalent

SERVED_VIDEO = "click"     # the video the single-video dashboard queries look at
PROCESSED_LEDGER = [0, 3]  # batches already recorded as processed
MERGE_WINDOW = "1 day"     # partials meet across batches at this width


def query(name: str, rows_only: bool = False):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if rows_only:
            ROWS_ONLY.add(name)
        return fn
    return deco


# -- aggregates -------------------------------------------------------------

@query("stream_metric_1m")
def q_stream_metric_1m(spark, sf):
    return stream_metric_partials(views.comments(spark, sf, with_message=False), "1 minute", viewers="exact")


@query("stream_metric_1h")
def q_stream_metric_1h(spark, sf):
    return stream_metric_partials(views.comments(spark, sf, with_message=False), "1 hour", viewers="exact")


@query("user_metric_1m")
def q_user_metric_1m(spark, sf):
    return user_metric_partials(views.comments(spark, sf, with_message=False), "1 minute")


@query("unique_viewers_exact")
def q_unique_viewers_exact(spark, sf):
    return unique_viewers(views.comments(spark, sf, with_message=False), "1 hour", method="exact")


@query("unique_viewers_approx", rows_only=True)
def q_unique_viewers_approx(spark, sf):
    return unique_viewers(views.comments(spark, sf, with_message=False), None, method="approx")


@query("unique_viewers_merged", rows_only=True)
def q_unique_viewers_merged(spark, sf):
    parts = stream_metric_partials(views.comments(spark, sf, with_message=False), MERGE_WINDOW,
                                   keys=["batch_id"], sketch=True)
    return _uv_merged(parts)


def _within_three_errors(viewers, exact):
    """Per video the exact count and whether the estimate lies within three relative standard errors."""
    both = exact.withColumnRenamed("unique_viewers", "exact_viewers").join(viewers, "video_id")
    near = F.abs(F.col("unique_viewers") - F.col("exact_viewers")) <= 3 * S.APPROX_DISTINCT_RSD * F.col("exact_viewers")
    return both.select("video_id", "exact_viewers", near.alias("within_bound"))


@query("unique_viewers_approx_bound")
def q_unique_viewers_approx_bound(spark, sf):
    return _within_three_errors(q_unique_viewers_approx(spark, sf),
                                unique_viewers(views.comments(spark, sf, with_message=False), None, method="exact"))


@query("unique_viewers_merged_bound")
def q_unique_viewers_merged_bound(spark, sf):
    return _within_three_errors(q_unique_viewers_merged(spark, sf),
                                unique_viewers(views.comments(spark, sf, with_message=False), None, method="exact"))


# -- merges across batches --------------------------------------------------

def _stream_partials(spark, sf, window=MERGE_WINDOW):
    return stream_metric_partials(views.comments(spark, sf, with_message=False), window, keys=["batch_id"], viewers="exact")


def _user_partials(spark, sf, window=MERGE_WINDOW, only_toxic=True):
    return user_metric_partials(views.comments(spark, sf, with_message=False), window, keys=["batch_id"],
                                only_toxic=only_toxic)


@query("merge_stream_metric")
def q_merge_stream_metric(spark, sf):
    return M.merge_stream_metric(_stream_partials(spark, sf))


@query("merge_stream_metric_half_even")
def q_merge_stream_metric_half_even(spark, sf):
    return M.merge_stream_metric(_stream_partials(spark, sf), rounding="half_even")


@query("merge_user_metric")
def q_merge_user_metric(spark, sf):
    return M.merge_user_metric(_user_partials(spark, sf))


@query("merge_user_metric_merged_scope")
def q_merge_user_metric_merged_scope(spark, sf):
    return M.user_metric(_user_partials(spark, sf, only_toxic=False), filter_scope="merged")


@query("merge_full_outer")
def q_merge_full_outer(spark, sf):
    parts = _stream_partials(spark, sf)
    last = views.BATCHES - 1
    state = M.merge_stream_metric(parts.where(F.col("batch_id") < last))
    return M.merge_full_outer(state, parts.where(F.col("batch_id") == last))


@query("merge_full_outer_nulls")
def q_merge_full_outer_nulls(spark, sf):
    rows = views.without_some_videos(views.comments(spark, sf, with_message=False))
    parts = stream_metric_partials(rows, MERGE_WINDOW, keys=["batch_id"], viewers="exact")
    last = views.BATCHES - 1
    state = M.merge_stream_metric(parts.where(F.col("batch_id") < last))
    return M.merge_full_outer(state, parts.where(F.col("batch_id") == last))


@query("change_feed_metric_nulls")
def q_change_feed_metric_nulls(spark, sf):
    rows = views.without_some_videos(views.comments(spark, sf, with_message=False))
    return M.metric_change_feed(stream_metric_partials(rows, MERGE_WINDOW, keys=["batch_id"], viewers="exact"))


@query("skip_processed_batches")
def q_skip_processed_batches(spark, sf):
    ledger = spark.createDataFrame([(b,) for b in PROCESSED_LEDGER], "batch_id long")
    return M.skip_processed_batches(views.comments(spark, sf, with_message=False), ledger)


@query("upsert_comments")
def q_upsert_comments(spark, sf):
    c = views.comments(spark, sf, with_message=False, extra=[views.doc_key(spark, sf)])
    latest = M.upsert_latest(views.with_replay(c), "comment_id", ["batch_id", "kafka_timestamp"])
    return views.attach_message(spark, sf, latest)


@query("change_feed_comment")
def q_change_feed_comment(spark, sf):
    c = views.scored_comments(spark, sf, with_message=False, extra=[views.doc_key(spark, sf)])
    first = M.first_delivery(views.with_replay(c), "comment_id", ["batch_id", "kafka_timestamp"])
    return views.attach_message(spark, sf, first.where(M.present("video_id"))).select("batch_id", *S.FEED_FIELDS)


@query("change_feed_metric")
def q_change_feed_metric(spark, sf):
    return M.metric_change_feed(_stream_partials(spark, sf))


# -- authors and leaderboards -----------------------------------------------

def _totals(spark, sf):
    return V.author_totals(user_metric_partials(views.comments(spark, sf, with_message=False), "1 minute"))


@query("author_totals")
def q_author_totals(spark, sf):
    return _totals(spark, sf)


@query("top_toxic_users")
def q_top_toxic_users(spark, sf):
    return V.top_authors(_totals(spark, sf), SERVED_VIDEO)


@query("top_toxic_users_all")
def q_top_toxic_users_all(spark, sf):
    return V.top_authors_all(_totals(spark, sf))


@query("leaderboard_view")
def q_leaderboard_view(spark, sf):
    return V.leaderboard_view(V.top_authors_all(_totals(spark, sf)))


@query("leaderboard_changes")
def q_leaderboard_changes(spark, sf):
    parts = user_metric_partials(views.comments(spark, sf, with_message=False), "1 minute", keys=["batch_id"])
    return _changes(parts)


@query("enrich_leaderboard")
def q_enrich_leaderboard(spark, sf):
    # only the board's few authors are looked up, over the comments of all videos
    board = V.top_authors_all(_totals(spark, sf))
    profiles = views.comments(spark, sf, with_message=False).join(board.select("author_id").distinct(), "author_id", "left_semi")
    return V.enrich_leaderboard(board, V.author_lookup(profiles))


# -- serving ----------------------------------------------------------------

@query("video_comments")
def q_video_comments(spark, sf):
    # top 100 on narrow rows, then the whole message text for those 100 only
    c = views.scored_comments(spark, sf, with_message=False, extra=[views.doc_key(spark, sf)])
    top = V.latest_comments(c, SERVED_VIDEO, carry=["doc_key"])
    return views.attach_message(spark, sf, top).select(*S.SERVED_COMMENT_FIELDS)


@query("video_comments_all")
def q_video_comments_all(spark, sf):
    # newest 100 per video for every video: partial window-group limit, then the text for the survivors
    c = views.scored_comments(spark, sf, with_message=False, extra=[views.doc_key(spark, sf)])
    top = V.latest_comments(c, None, carry=["doc_key"])
    return views.attach_message(spark, sf, top).select("video_id", *S.SERVED_COMMENT_FIELDS)


def _feed_rows(spark, sf, with_message=True):
    extra = [] if with_message else [views.doc_key(spark, sf)]
    cols = S.FEED_FIELDS if with_message else [c for c in S.FEED_FIELDS if c != "message"] + ["doc_key"]
    return views.scored_comments(spark, sf, with_message=with_message, extra=extra).select(*cols, "batch_id")


@query("rolling_feed")
def q_rolling_feed(spark, sf):
    rows = _feed_rows(spark, sf, with_message=False).where(F.col("video_id") == SERVED_VIDEO)
    last = views.BATCHES - 1
    held = V.rolling_feed(rows.where(F.col("batch_id") < last), None, carry=["doc_key"]).drop("position")
    feed = V.push_to_feed(rows.where(F.col("batch_id") == last), held, carry=["doc_key"]).drop("position")
    return views.attach_message(spark, sf, feed).select(*S.FEED_FIELDS, "batch_id")


@query("rolling_feed_all")
def q_rolling_feed_all(spark, sf):
    # every video's feed at once: per-video top 100 (partial window-group limit), text for the survivors only
    rows = _feed_rows(spark, sf, with_message=False)
    feed = V.rolling_feed(rows, None, carry=["doc_key"])
    return views.attach_message(spark, sf, feed).select(*S.FEED_FIELDS, "batch_id", "position")


@query("feed_view")
def q_feed_view(spark, sf):
    return V.feed_view(_feed_rows(spark, sf).where(F.col("video_id") == SERVED_VIDEO))


@query("feed_count")
def q_feed_count(spark, sf):
    # a count needs no message text: every comment has its document
    return V.feed_count(V.rolling_feed(_feed_rows(spark, sf, with_message=False), None))


@query("recent_windows")
def q_recent_windows(spark, sf):
    metrics = stream_metric_partials(views.comments(spark, sf, with_message=False), "1 hour", viewers="exact")
    return V.recent_windows(metrics, SERVED_VIDEO)


@query("recent_windows_all")
def q_recent_windows_all(spark, sf):
    metrics = stream_metric_partials(views.comments(spark, sf, with_message=False), "1 hour", viewers="exact")
    return V.recent_windows(metrics, None)


@query("upsert_recent_windows")
def q_upsert_recent_windows(spark, sf):
    feed = M.metric_change_feed(_stream_partials(spark, sf, "1 hour"))
    return V.upsert_recent_windows(feed, SERVED_VIDEO)


@query("upsert_recent_windows_all")
def q_upsert_recent_windows_all(spark, sf):
    feed = M.metric_change_feed(_stream_partials(spark, sf, "1 hour"))
    return V.upsert_recent_windows(feed, None)


@query("latest_status")
def q_latest_status(spark, sf):
    return V.latest_status(views.status_log(spark, sf))


@query("trim_status_log")
def q_trim_status_log(spark, sf):
    return V.trim_log(views.status_log(spark, sf))


# -- text, scoring, policy --------------------------------------------------

def _documents(spark, sf):
    return spread_for_cpu(views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("message")), any_size=True)


@query("clean_messages")
def q_clean_messages(spark, sf):
    return _clean(_documents(spark, sf)).select("doc_id", "message_clean")


@query("clean_messages_nfd")
def q_clean_messages_nfd(spark, sf):
    docs = _documents(spark, sf)
    return _clean(docs.withColumn("message", views.decomposed(F.col("message")))).select("doc_id", "message_clean")


@query("score_comments")
def q_score_comments(spark, sf):
    c = views.scored_comments(spark, sf, with_message=False)
    return c.select("comment_id", *[F.col(f"predictions.{l}").alias(l) for l in S.LABELS],
                    "toxic_score", "toxic_category")


@query("apply_policy")
def q_apply_policy(spark, sf):
    return apply_policy(views.comments(spark, sf, with_message=False)).select(
        "comment_id", "toxic_score", "toxic_label", "recommended_action")


def _score_documents(spark, sf, scorer):
    docs = scorer.score(_clean(_documents(spark, sf)))
    out = apply_policy(top_label(docs, "predictions"))
    return out.select("doc_id", *[F.col(f"predictions.{l}").alias(l) for l in S.LABELS],
                      "toxic_score", "toxic_category", "toxic_label", "recommended_action")


@query("score_documents")
def q_score_documents(spark, sf):
    return _score_documents(spark, sf, LexiconScorer())


@query("score_documents_model", rows_only=True)
def q_score_documents_model(spark, sf):
    return _score_documents(spark, sf, ModelScorer(lexicon_model_loader))


@query("score_documents_learned", rows_only=True)
def q_score_documents_learned(spark, sf):
    # the model learns from the labelled documents outside the held-out fold, and scores all
    labels = views.table(spark, sf, "labels").where("crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", "toxic")
    known = views.table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    return _score_documents(spark, sf, fit_ngrams(known, ["toxic"]).scorer())


def _turns(spark, sf):
    """Conversation turns as chat messages (every role, whole texts)."""
    return spread_for_cpu(views.table(spark, sf, "conversations")
                          .select("conv_id", "turn", F.col("text").alias("message")), any_size=True)


@query("clean_conversations")
def q_clean_conversations(spark, sf):
    return _clean(_turns(spark, sf)).select("conv_id", "turn", "message_clean")


@query("score_conversations")
def q_score_conversations(spark, sf):
    turns = apply_policy(top_label(LexiconScorer().score(_clean(_turns(spark, sf))), "predictions"))
    return turns.select("conv_id", "turn", *[F.col(f"predictions.{l}").alias(l) for l in S.LABELS],
                        "toxic_score", "toxic_category", "toxic_label", "recommended_action")


@query("score_logits")
def q_score_logits(spark, sf):
    c = views.comments(spark, sf, with_message=False)
    logit = (F.col("toxic_score") - 0.5) * 10
    return c.select("comment_id", logit.alias("logit"), round_score(sigmoid(logit)).alias("score"))


# -- the whole path: topic records to the three outputs ------------------------

def _transformed(spark, sf):
    scored = transform_comments(_decode(views.topic_records(spark, sf)))
    return scored.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("pipeline_comments")
def q_pipeline_comments(spark, sf):
    return _transformed(spark, sf).select("comment_id", "video_id", "author_id", "message", "published_at", "kafka_timestamp",
                                          "toxic_score", "toxic_category", "toxic_label", "recommended_action")


@query("pipeline_stream_metric")
def q_pipeline_stream_metric(spark, sf):
    return stream_metric_partials(_transformed(spark, sf), viewers="exact")


@query("pipeline_user_metric")
def q_pipeline_user_metric(spark, sf):
    return user_metric_partials(_transformed(spark, sf))


# -- counted once, versions, look-ups ------------------------------------------

def _deliveries(spark, sf, rows=views.comments):
    """Comments with their place on the topic (as in ``views.topic_records``)."""
    return rows(spark, sf, with_message=False, extra=[(F.length("event_type") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset")])


@query("effective_once_metric")
def q_effective_once_metric(spark, sf):
    # a stream committed batches 0 to 4, lost its checkpoint and reads the whole topic again
    topic = _deliveries(spark, sf)
    done = topic.where(F.col("batch_id") <= 4)
    again = O.outside_runs(topic, O.offset_runs(done))
    return stream_metric_partials(done.unionByName(again), "1 hour", viewers="exact")


@query("first_over_all_batches")
def q_first_over_all_batches(spark, sf):
    # fourteen batches of which seven are redeliveries, taken in three steps; between steps only bitmaps are kept
    shared_dir(spark)
    rows = views.with_replay(_deliveries(spark, sf))
    state, firsts = None, None
    for lo, hi in ((0, 4), (5, 9), (10, 13)):
        step = rows.where(F.col("batch_id").between(lo, hi))
        new = O.first_deliveries(step, ["batch_id"], state=state)
        firsts = new if firsts is None else firsts.unionByName(new)
        bits = O.offset_bitmaps(step)
        state = O.merge_bitmaps(bits if state is None else state.unionByName(bits)).checkpoint()
    return M.merge_stream_metric(stream_metric_partials(firsts, MERGE_WINDOW, keys=["batch_id"], viewers="exact"))


def _versioned_store(spark, sf):
    """Three versions, compacted after the second, then a second stream that reads everything again."""
    store = VersionedStore(spark, shared_dir(spark, f"versions-{uuid.uuid4().hex}"))
    # each batch is sorted and grouped where it is read, so a task must not read more as the events grow
    rows = spread_for_cpu(_deliveries(spark, sf, views.scored_comments), any_size=True)
    for number, (lo, hi) in enumerate(((0, 2), (3, 4), (5, 6))):
        process_batch(rows.where(F.col("batch_id").between(lo, hi)).drop("batch_id"), number, store, "first", window="1 hour")
        if number == 1:
            store.compact()
    process_batch(rows.drop("batch_id"), 0, store, "second", window="1 hour")
    return store


@query("metric_at_version")
def q_metric_at_version(spark, sf):
    return _versioned_store(spark, sf).at(2).stream_metric().select("video_id", "window_start", "window_end", "total_comments", "toxic_count", "toxic_ratio")


@query("live_metric_changes")
def q_live_metric_changes(spark, sf):
    # the streaming reader follows the store's versions; its rows, written as a table
    store = _versioned_store(spark, sf)
    out = f"{store.root}/followed"
    followed = (read_changes(spark, store.root, "stream_metric").writeStream.format("parquet").option("path", out)
                .option("checkpointLocation", f"{store.root}/_checkpoints/followed").trigger(availableNow=True).start())
    followed.awaitTermination()
    window = F.col("window_start").cast("timestamp_ntz").alias("window_start")      # as in the store; the stream carries instants
    return spark.read.parquet(out).select("commit_version", "video_id", window, "op", "total_comments", "toxic_count")


def _indexed(spark, sf):
    path = shared_dir(spark, f"indexed-{uuid.uuid4().hex}")
    I.write_indexed(views.scored_comments(spark, sf, with_message=False), path)
    return path


_LOOKED_UP = ["comment_id", "video_id", "author_id", "published_at", "toxic_score"]


@query("indexed_ids")
def q_indexed_ids(spark, sf):
    # the newest comment of every author, looked up by its id
    asked = views.table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").cast("string").alias("comment_id"))
    return I.find_ids(spark, _indexed(spark, sf), asked).select(*_LOOKED_UP)


@query("indexed_span")
def q_indexed_span(spark, sf):
    # the last day of the served video
    path = _indexed(spark, sf)
    last = spark.read.parquet(f"{path}/rows").agg(F.max("published_at")).first()[0]
    start = spark.range(1).select((F.lit(last) - F.expr("interval 1 day"))).first()[0]
    return I.find_span(spark, path, SERVED_VIDEO, start, last).select(*_LOOKED_UP)


@query("top_toxic_users_two_pass")
def q_top_toxic_users_two_pass(spark, sf):
    return top_authors_two_pass(user_metric_partials(views.comments(spark, sf, with_message=False), "1 minute"))


@query("viewers_any_span")
def q_viewers_any_span(spark, sf):
    # spans of 17 to 680 minutes from every hour of every video: sketches against exact counts
    rows = views.comments(spark, sf, with_message=False).select("video_id", "author_id", "kafka_timestamp", R.minute_of(F.col("kafka_timestamp")).alias("minute"))
    hour = F.floor(F.col("minute") / 60).cast("long")
    spans = rows.select("video_id", hour.alias("h")).distinct().select("video_id", (F.col("h") * 60).alias("first"), (
        F.col("h") * 60 + (F.pmod("h", F.lit(40)) + 1) * 17 - 1).alias("last"))
    estimates = R.viewers_of_spans(R.sketch_tree(R.minute_sketches(rows)), spans)
    # a row meets only the spans of its hour
    hours = spans.select("*", F.explode(F.sequence(F.floor(F.col("first") / 60), F.floor(F.col("last") / 60))).alias("h"))
    exact = rows.withColumn("h", hour).join(hours, ["video_id", "h"]).where(F.col("minute").between(F.col("first"), F.col("last")))
    exact = exact.groupBy("video_id", "first", "last").agg(F.count_distinct("author_id").alias("exact_viewers"))
    near = F.abs(F.col("unique_viewers") - F.col("exact_viewers")) <= 3 * S.APPROX_DISTINCT_RSD * F.col("exact_viewers")
    return exact.join(estimates, ["video_id", "first", "last"]).select("video_id", "first", "last", "exact_viewers", near.alias("within_bound"))


# -- sources and sinks ------------------------------------------------------

@query("decode_comments")
def q_decode_comments(spark, sf):
    return _decode(views.topic_records(spark, sf))


@query("decode_damaged")
def q_decode_damaged(spark, sf):
    # records without id or value drop at the decode step, those without a message at the cleaning step
    rows = _clean(_parse(_decode(views.damaged_records(spark, sf)), zone_free=True))
    return rows.select("comment_id", "video_id", "message", "author_id", "published_at", "kafka_timestamp", "offset", "partition")


@query("decode_rejects")
def q_decode_rejects(spark, sf):
    return comment_rejects(views.damaged_records(spark, sf))


@query("snake_case_columns")
def q_snake_case_columns(spark, sf):
    rec = views.topic_records(spark, sf)
    return _snake(rec.select(F.from_json("value", S.PAYLOAD_SCHEMA).alias("d")).select("d.*"))


@query("to_keyed_messages")
def q_to_keyed_messages(spark, sf):
    c = views.comments(spark, sf).withColumn("published_at", views.iso(F.col("published_at")))
    payload = c.select(F.col("comment_id").alias("commentId"), F.col("video_id").alias("videoId"), "message",
                       F.col("author_id").alias("authorId"), F.col("author_image").alias("authorImage"),
                       F.col("author_name").alias("authorName"), F.col("published_at").alias("publishedAt"))
    keyed = _keyed(payload)
    return keyed.select("key", F.from_json("value", S.PRODUCER_PAYLOAD_SCHEMA).alias("v")).select("key", "v.*")


@query("parse_published_at")
def q_parse_published_at(spark, sf):
    return _parse(views.published_strings(spark, sf), zone_free=True)


@query("flatten_chat_pages")
def q_flatten_chat_pages(spark, sf):
    return _flatten(views.chat_pages(spark, sf))


@query("extract_video_id")
def q_extract_video_id(spark, sf):
    return extract_video_id(views.video_urls(spark, sf), form="server")


@query("extract_video_id_client")
def q_extract_video_id_client(spark, sf):
    return extract_video_id(views.video_urls(spark, sf), form="client")


@query("extract_video_id_pages")
def q_extract_video_id_pages(spark, sf):
    # crawled page URLs (query strings, fragments, sub-domains): none is a video link
    pages = views.table(spark, sf, "pages").select("page_id", "url")
    return extract_video_id(pages, form="server")
