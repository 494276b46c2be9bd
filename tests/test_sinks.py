"""Keyed messages to files, bounded status log, leaderboard changes inside a batch."""

import json
import os

from pyspark.sql import functions as F

from chatmod.operators.serving import latest_status
from chatmod.plans import views
from chatmod.sources.topic import decode_comments, to_keyed_messages
from chatmod.streaming.job import process_batch, transform_comments
from chatmod.streaming.sinks import StatusLog, write_keyed_messages
from chatmod.streaming.store import PartialStore

SF = "/root/testdata/sf0.001"


def test_keyed_messages_to_files(spark, scratch):
    df = spark.createDataFrame([("c1", "v1", "hi"), ("c2", "v2", "yo")], "commentId string, videoId string, message string")
    out = os.path.join(scratch, "msgs")
    write_keyed_messages(to_keyed_messages(df), fmt="json", path=out)
    back = {r.key: json.loads(r.value) for r in spark.read.json(out).collect()}
    assert back["v2"]["message"] == "yo" and back["v1"]["type"] == "CHAT"


def test_status_log_trim_and_latest(spark, scratch):
    log = StatusLog(spark, os.path.join(scratch, "status"), capacity=5)
    rows = [(i, ["running", "stopped", "ended", "error"][i % 4], f"chat{i % 2}", f"v{i % 2}") for i in range(12)]
    log.append(spark.createDataFrame(rows, "seq long, type string, live_chat_id string, video_id string"))
    kept = log.trim()
    assert sorted(r.seq for r in kept.collect()) == [7, 8, 9, 10, 11]
    latest = {r.video_id: (r.type, r.seq) for r in latest_status(kept, lookback=3).collect()}
    assert latest == {"v1": ("error", 11), "v0": ("ended", 10)}
    # a trim that died before committing leaves a folder without _SUCCESS: ignored
    os.makedirs(os.path.join(scratch, "status", "gen=9"))
    log.append(spark.createDataFrame([(12, "running", "chat0", "v0")], "seq long, type string, live_chat_id string, video_id string"))
    assert sorted(r.seq for r in log.read().collect()) == [7, 8, 9, 10, 11, 12]
    kept = log.trim()
    assert sorted(r.seq for r in kept.collect()) == [8, 9, 10, 11, 12]


def test_leaderboard_changes_in_batches(spark, scratch):
    store = PartialStore(spark, os.path.join(scratch, "store"))
    scored = transform_comments(decode_comments(views.topic_records(spark, SF)))
    # force scores so that one author dominates video "click"
    scored = scored.withColumn("toxic_score", F.when(F.col("author_id") == "7", 0.95).otherwise(0.1))
    process_batch(scored, 0, store, "s1", leaderboards=True)
    process_batch(scored.where(F.col("author_id") != "7").limit(5), 1, store, "s1", leaderboards=True)
    changes = spark.read.parquet(store.path("leaderboard_changes")).collect()
    assert {r.batch_id for r in changes} == {0}      # batch 1 added no toxic rows: no board changed
    assert all(r.leaderboard.startswith("7:") for r in changes)


def test_in_batch_leaderboards_equal_batch_changes(spark, scratch):
    from chatmod.operators.leaderboard import leaderboard_changes
    from chatmod.streaming.leaderboards import board_changes

    store = PartialStore(spark, os.path.join(scratch, "store"))
    scored = transform_comments(decode_comments(views.topic_records(spark, SF)))
    scored = scored.withColumn("toxic_score", F.when(F.col("offset") % 4 == 0, 0.95).otherwise(0.1))
    for b in range(3):
        process_batch(scored.where(F.col("offset") % 3 == b), b, store, "s1", leaderboards=True)
    got = {(r.video_id, r.batch_id, r.leaderboard)
           for r in board_changes(store, "s1", table="leaderboard_changes").collect()}
    deltas = (scored.where(F.col("toxic_score") >= 0.7)
                    .groupBy("video_id", "author_id", (F.col("offset") % 3).alias("batch_id"))
                    .agg(F.count(F.lit(1)).alias("toxic_count")))
    want = {(r.video_id, r.batch_id, r.leaderboard) for r in leaderboard_changes(deltas).collect()}
    assert got == want and {b for _, b, _ in got} == {0, 1, 2}


def test_current_boards_equal_recomputed_leaderboards(spark, scratch):
    from chatmod.operators.serving import author_totals, top_authors_all
    from chatmod.streaming.leaderboards import current_boards

    store = PartialStore(spark, os.path.join(scratch, "store"))
    scored = transform_comments(decode_comments(views.topic_records(spark, SF)))
    scored = scored.withColumn("toxic_score", F.when(F.col("offset") % 4 == 0, 0.95).otherwise(0.1))
    for b in range(3):
        process_batch(scored.where(F.col("offset") % 3 == b), b, store, "s1", leaderboards=True)
    got = {tuple(r) for r in current_boards(store, "s1", table="leaderboard_changes").collect()}
    want = {(r.video_id, r.rank, r.author_id, r.toxic_count)
            for r in top_authors_all(author_totals(store.user_metric())).collect()}
    assert got == want and len(got) > 0
    click = {tuple(r) for r in current_boards(store, "s1", "click", table="leaderboard_changes").collect()}
    assert click == {x for x in want if x[0] == "click"}


def test_status_log_stream_follows_appends_across_trims(spark, scratch):
    root = os.path.join(scratch, "status")
    log = StatusLog(spark, root, capacity=5)
    out, ckpt = os.path.join(scratch, "pushed"), os.path.join(scratch, "ckpt")
    schema = "seq long, type string, live_chat_id string, video_id string"

    def rows(lo, hi):
        return spark.createDataFrame([(i, "running", f"chat{i % 2}", f"v{i % 2}") for i in range(lo, hi)], schema)

    def push():
        q = (log.read_stream().writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None
        return sorted(r.seq for r in spark.read.parquet(out).collect())

    log.append(rows(0, 12))
    assert push() == list(range(12))
    log.append(rows(12, 15))
    assert push() == list(range(15))                       # only the new events, once
    assert sorted(r.seq for r in log.trim().collect()) == [10, 11, 12, 13, 14]
    blocks = sorted(d for d in os.listdir(os.path.join(root, "feed")) if d.startswith("block="))
    assert blocks == ["block=2"]                           # blocks before seq 10 are gone
    log.append(rows(15, 17))
    assert push() == list(range(17))
