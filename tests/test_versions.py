"""Versions over several tables, the offset ledger, live change feeds, compaction by range, record-bounded files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chatmod.operators import merge as M
from chatmod.operators import offsets as O
from chatmod.operators.metrics import stream_metric_partials
from chatmod.session import shared_dir
from chatmod.sources.change_feed import read_changes
from chatmod.sources.record_lines import read_record_lines
from chatmod.sources.topic import comment_rejects, decode_comments, read_comment_stream
from chatmod.streaming.job import process_batch, start_stream, transform_comments
from chatmod.streaming.versions import BatchWriter, CommitConflict, VersionedStore

# -- offsets --------------------------------------------------------------------------------------------------------


def deliveries(rng):
    """(partition, offset) with holes, unbroken stretches over bucket borders, repeats and nulls."""
    rows = [(0, o) for o in range(32_700, 98_400)] + [(1, rng.randrange(200_000)) for _ in range(300)] + [(2, 0), (2, 32_767), (2, 32_768)]
    rows += rng.choices(rows, k=500) + [(None, 5), (1, None), (None, None)]
    rng.shuffle(rows)
    return rows


def runs_of(rows):
    out = []
    for p, o in sorted({(p, o) for p, o in rows if p is not None and o is not None}):
        if out and out[-1][0] == p and out[-1][2] == o - 1:
            out[-1][2] = o
        else:
            out.append([p, o, o])
    return sorted(map(tuple, out))


def test_ledgers_equal_sets_of_offsets(spark):
    rng = random.Random(7)
    first, second = deliveries(rng), [(p, o + 50 if o is not None and rng.random() < 0.5 else o) for p, o in deliveries(rng)]
    frames = [spark.createDataFrame(r, "partition int, offset long").repartition(3) for r in (first, second)]
    runs = [O.offset_runs(f) for f in frames]
    assert sorted(map(tuple, runs[0].collect())) == runs_of(first)
    assert sorted(map(tuple, O.merge_runs(runs[0].unionByName(runs[1])).collect())) == runs_of(first + second)
    seen = set(first)
    want = sorted(((p, o) for p, o in second if p is None or o is None or (p, o) not in seen), key=str)
    assert sorted(map(tuple, O.outside_runs(frames[1], runs[0]).collect()), key=str) == want
    state = O.merge_bitmaps(O.offset_bitmaps(frames[0]))
    assert sorted(map(tuple, O.unseen(frames[1], state).collect()), key=str) == want
    united = O.merge_bitmaps(state.unionByName(O.offset_bitmaps(frames[1])))
    both = spark.createDataFrame(first + second + [(0, 10**12), (3, 7)], "partition int, offset long")
    left = O.unseen(both, united).where("partition is not null and offset is not null")
    assert sorted(map(tuple, left.collect())) == [(0, 10**12), (3, 7)]
    # the full bucket 32,768 .. 65,535 and its neighbour are one run without bits
    assert [(r.bucket, r.last_bucket) for r in united.where("bits is null").collect()] == [(1, 2)]


def test_ledger_does_not_grow_with_an_unbroken_history(spark):
    shared_dir(spark)
    state = None
    for k in range(6):
        bits = O.offset_bitmaps(spark.range(k * 65_536, (k + 1) * 65_536).select(F.lit(0).alias("partition"), F.col("id").alias("offset")))
        state = O.merge_bitmaps(bits if state is None else state.unionByName(bits)).checkpoint()
    assert [tuple(r) for r in state.collect()] == [(0, 0, 11, None)]


# -- a store of versions ---------------------------------------------------------------------------------------------

BASE = 1_700_000_000 - 1_700_000_000 % 3600


def scored(spark, rows):
    """(comment, video, author, minute, score, offset) as scored comments."""
    frame = spark.createDataFrame([(f"c{c}", v, f"u{a}", BASE + 60 * m, s, o) for c, v, a, m, s, o in rows],
                                  "comment_id string, video_id string, author_id string, at long, toxic_score double, offset long")
    at = F.timestamp_seconds("at")
    return frame.select("comment_id", "video_id", F.concat(F.lit("text "), "comment_id").alias("message"), "author_id", F.lit("i").alias("author_image"),
                        F.concat(F.lit("n"), "author_id").alias("author_name"), at.alias("published_at"), at.alias("kafka_timestamp"), "offset",
                        (F.col("offset") % 2).cast("int").alias("partition"), "toxic_score", F.lit("toxic").alias("toxic_category"),
                        F.lit("Toxic").alias("toxic_label"), F.lit("Hide").alias("recommended_action"))


def rows_of(lo, hi, hour=0):
    return [(o, "v" if o % 3 else "w", o % 5, 60 * hour + o % 7, 0.95 if o % 2 else 0.1, o) for o in range(lo, hi)]


def state(store):
    metric = store.stream_metric().select("video_id", "window_start", "total_comments", "toxic_count", "unique_viewers", "unique_viewers_merged", "version")
    users = store.user_metric().select("video_id", "author_id", "window_start", "total_comments", "toxic_count", "author_name", "version")
    comments = store.comments().select("comment_id", "message", "offset")
    return [sorted(map(tuple, f.collect())) for f in (metric, users, comments)]


def feed(rows):
    return sorted((r.commit_version, r.video_id, r.window_start, r.op, r.total_comments, r.toxic_count, r.unique_viewers) for r in rows)


def test_tables_change_together_and_batches_count_once(spark, scratch, monkeypatch):
    store = VersionedStore(spark, os.path.join(scratch, "store"))
    process_batch(scored(spark, rows_of(0, 40)), 0, store, "s")
    assert store.latest() == 1
    first = state(store)
    real = BatchWriter.write

    def dies(self, df, table, stream_id, batch_id):
        if table == "user_metric":
            raise RuntimeError("executor lost")
        real(self, df, table, stream_id, batch_id)

    with monkeypatch.context() as patch:
        patch.setattr(BatchWriter, "write", dies)
        with pytest.raises(RuntimeError, match="executor lost"):
            process_batch(scored(spark, rows_of(40, 60)), 1, store, "s")
    assert store.latest() == 1 and state(store) == first            # half written: in no table
    process_batch(scored(spark, rows_of(40, 60)), 1, store, "s")
    second = state(store)
    assert len(second[2]) == 60 and sum(r[2] for r in second[0]) == 60
    process_batch(scored(spark, rows_of(40, 60)), 1, store, "s")    # committed before its checkpoint was
    # a stream with a new checkpoint starts from the first offset, in other batches
    process_batch(scored(spark, rows_of(0, 25)), 0, store, "t")
    process_batch(scored(spark, rows_of(25, 70)), 1, store, "t")
    third = state(store)
    assert store.latest() == 4 and len(third[2]) == 70 and sum(r[2] for r in third[0]) == 70
    # all tables as of one version, before and after compaction
    assert state(store.at(1)) == first and state(store.at(2)) == second == state(store.at(3))
    assert sorted(map(tuple, store.ledger().collect())) == [(0, k, k) for k in range(0, 70, 2)] + [(1, k, k) for k in range(1, 70, 2)]
    store.compact()
    assert [r[:-1] for r in state(store)[0]] == [r[:-1] for r in third[0]] and state(store)[2] == third[2]
    process_batch(scored(spark, rows_of(0, 70)), 0, store, "u")
    assert state(store)[0] == third[0] and state(store)[1] == third[1]


def test_a_writer_that_lost_the_race_is_refused(spark, scratch):
    store = VersionedStore(spark, os.path.join(scratch, "store"))
    late = store.begin("late", 0)
    process_batch(scored(spark, rows_of(0, 5)), 0, store, "s")
    batch = late.fresh(scored(spark, rows_of(0, 5)))                # its ledger is older than that commit
    late.write(batch, "comments", "late", 0)
    late.write(stream_metric_partials(batch, sketch=True), "stream_metric", "late", 0)
    late.write(batch.limit(0).select("video_id"), "user_metric", "late", 0)
    late.record(batch)
    with pytest.raises(CommitConflict):
        late.commit()
    assert len(state(store)[2]) == 5


def test_restarts_without_their_checkpoint_change_nothing(spark, scratch):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)
    for i in range(2):
        with open(os.path.join(inbox, f"{i}.json"), "w") as f:
            for o in range(30 * i, 30 * i + 30):
                value = {"commentId": f"c{o}", "videoId": "v", "message": "idiot idiot idiot clown" if o % 2 else "hello", "authorId": f"u{o % 4}",
                         "publishedAt": "2024-01-01T00:00:00Z"}
                f.write(json.dumps({"key": "v", "value": json.dumps(value), "topic": "comment", "partition": 0, "offset": o,
                                    "timestamp": f"2024-01-01T00:0{o % 3}:00Z"}) + "\n")
    store = VersionedStore(spark, os.path.join(scratch, "store"))
    seen = []
    for run in range(2):
        records = read_comment_stream(spark, "json", inbox, {"maxFilesPerTrigger": 1 + run})
        q = start_stream(spark, records, store, os.path.join(scratch, f"ckpt{run}"), trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None
        seen.append(state(store))
    assert seen[0] == seen[1] and len(seen[0][2]) == 60 and sum(r[2] for r in seen[0][0]) == 60 and seen[0][1]
    assert sorted(map(tuple, store.ledger().collect())) == [(0, 0, 59)]


def test_live_feed_equals_the_batch_feed_across_compactions(spark, scratch):
    store = VersionedStore(spark, os.path.join(scratch, "store"))
    batches = [rows_of(0, 20), rows_of(20, 45, hour=1), rows_of(45, 60) + rows_of(10, 15), rows_of(60, 80, hour=1)]
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")

    def follow():
        for table in ("stream_metric", "comments"):
            q = (read_changes(spark, store.root, table).writeStream.format("parquet").option("path", f"{out}/{table}")
                 .option("checkpointLocation", f"{ckpt}/{table}").trigger(availableNow=True).start())
            q.awaitTermination(300)
            assert q.exception() is None

    for b, rows in enumerate(batches):
        process_batch(scored(spark, rows), b, store, "s")
        if b in (0, 2):
            follow()
        if b in (1, 2):
            store.compact()
    follow()
    live = spark.read.parquet(f"{out}/stream_metric").collect()
    assert feed(live) == feed(store.changes("stream_metric").collect()) and {r.op for r in live} == {"insert", "update"}
    # the same as the feed over plain partials of the batches, each offset counted once
    parts = None
    for b, rows in enumerate(batches):
        rows = [r for r in rows if not any(r in x for x in batches[:b])]
        one = stream_metric_partials(scored(spark, rows)).withColumn("batch_id", F.lit(b).cast("long"))
        parts = one if parts is None else parts.unionByName(one)
    want = sorted((r.batch_id + 1, r.video_id, r.window_start, r.op, r.total_comments, r.toxic_count, r.unique_viewers) for r in M.metric_change_feed(parts).collect())
    assert feed(live) == want
    comments = spark.read.parquet(f"{out}/comments")
    assert sorted(r.comment_id for r in comments.collect()) == sorted(f"c{o}" for o in range(80))
    assert {(r.comment_id, r.commit_version) for r in comments.collect()} == {(r.comment_id, r.commit_version) for r in store.changes("comments").collect()}
    # snapshot, then changes: the snapshot of version 2 and the changes after it give the newest totals
    totals = {(r.video_id, r.window_start): r.total_comments for r in store.at(3).stream_metric().collect()}
    for r in sorted(store.changes("stream_metric", since=3).collect(), key=lambda r: r.commit_version):
        totals[r.video_id, r.window_start] = r.total_comments
    assert totals == {(r.video_id, r.window_start): r.total_comments for r in store.stream_metric().collect()}
    with pytest.raises(ValueError, match="folded away"):
        state(store.at(1))


def test_compaction_rewrites_only_the_ranges_of_new_rows(spark, scratch):
    store = VersionedStore(spark, os.path.join(scratch, "store"))
    history = [(o, f"v{o % 4}", o, 60 * (o % 20) + o % 60, 0.95, o) for o in range(4000)]        # twenty hours
    process_batch(scored(spark, history), 0, store, "s")
    whole = store.compact()
    process_batch(scored(spark, rows_of(5000, 5020, hour=3)), 1, store, "s")
    before = state(store)
    part = store.compact()
    for table in ("comments", "stream_metric", "user_metric"):
        assert whole[table]["ranges_rewritten"] == 20 == part[table]["ranges"] and part[table]["ranges_rewritten"] == 1
        assert part[table]["bytes_written"] < whole[table]["bytes_written"] / 4
    after = state(store)
    assert [r[:-1] for r in after[0]] == [r[:-1] for r in before[0]] and after[1:] == before[1:] and len(after[2]) == 4020
    process_batch(scored(spark, rows_of(6000, 6010, hour=4)), 2, store, "s")
    store.compact()                                         # deletes what the second manifest replaced
    gens = os.listdir(store.path("comments__ranges"))
    dirs = [(g, r) for g in gens for r in os.listdir(os.path.join(store.path("comments__ranges"), g)) if r.startswith("range_id=")]
    assert len(dirs) == 20 + 1                              # one replaced folder is still there for readers
    assert len(state(store)[2]) == 4030
    plan = store.comments("v1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(video_id,v1)" in plan


# -- record-bounded files --------------------------------------------------------------------------------------------

def test_files_are_admitted_record_by_record(spark, scratch):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)

    def put(name, lo, hi, mode="w"):
        with open(os.path.join(inbox, name), mode) as f:
            for o in range(lo, hi):
                value = json.dumps({"commentId": f"c{o}", "videoId": "v", "message": "é" * (o % 9)}) if o % 50 else "broken"
                f.write(json.dumps({"key": "v", "value": value, "topic": "comment", "partition": 0, "offset": o, "timestamp": "2024-01-01T00:00:00Z"}) + "\n")

    put("a.json", 0, 950)
    put("b.json", 950, 1000)
    sizes = []

    def run():
        def count(batch, batch_id):
            rows = batch.persist()
            sizes.append(rows.count())
            decode_comments(rows).select("comment_id").write.mode("append").parquet(os.path.join(scratch, "good"))
            comment_rejects(rows).select("offset").write.mode("append").parquet(os.path.join(scratch, "bad"))
            rows.unpersist()

        q = read_record_lines(spark, inbox, 100).writeStream.foreachBatch(count).option("checkpointLocation", os.path.join(scratch, "ckpt")).start()
        q.processAllAvailable()
        q.stop()

    run()
    assert sizes == [100] * 10
    with open(os.path.join(inbox, "b.json"), "a") as f:
        f.write('{"key": "v", "value": "half a li')              # not whole yet
    put("c.json", 1000, 1130)
    run()                                                       # goes on after the last record read
    assert sizes[10:] == [100, 30]
    assert sorted(int(r.comment_id[1:]) for r in spark.read.parquet(os.path.join(scratch, "good")).collect()) == [o for o in range(1130) if o % 50]
    assert sorted(r.offset for r in spark.read.parquet(os.path.join(scratch, "bad")).collect()) == list(range(0, 1130, 50))
