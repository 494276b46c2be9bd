"""Per-batch partials, cross-batch merges, approximate counts (FIXTURES §5: F6-F8)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatmod.operators import merge as M
from chatmod.operators.metrics import stream_metric_partials, unique_viewers, unique_viewers_merged, user_metric_partials
from chatmod.plans import views

T0 = dt.datetime(2024, 1, 1, 10, 0, 5)
SCHEMA = ("comment_id string, video_id string, author_id string, author_name string, author_image string, "
          "published_at timestamp_ntz, kafka_timestamp timestamp_ntz, toxic_score double, batch_id long")


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _c(i, author, score, batch, secs=0, video="v"):
    ts = T0 + dt.timedelta(seconds=secs)
    return (f"c{i}", video, author, f"name_{author}_{batch}", "", ts, ts, score, batch)


def test_strict_vs_inclusive_threshold(spark):
    df = _rows(spark, [_c(1, "a", 0.7, 0), _c(2, "a", 0.701, 0), _c(3, "b", 0.5, 0)])
    s = stream_metric_partials(df).collect()[0]
    u = {r.author_id: r for r in user_metric_partials(df).collect()}
    assert s.toxic_count == 1 and s.total_comments == 3 and s.toxic_ratio == 0.333
    assert u["a"].toxic_count == 2 and "b" not in u


def test_viewers_additive_vs_merged_f6(spark):
    rows = [_c(1, "a", 0.1, 0), _c(2, "b", 0.1, 1), _c(3, "a", 0.1, 2)]
    parts = stream_metric_partials(_rows(spark, rows), keys=["batch_id"], sketch=True)
    merged = M.merge_stream_metric(parts).collect()[0]
    assert merged.version == 3
    assert merged.unique_viewers == 3 and merged.unique_viewers_merged == 2


def test_filter_scope_f7(spark):
    rows = [_c(1, "a", 0.9, 0), _c(2, "a", 0.1, 1), _c(3, "a", 0.2, 1)]
    parts = user_metric_partials(_rows(spark, rows), keys=["batch_id"], only_toxic=False)
    batch = M.user_metric(parts, "batch").collect()[0]
    merged = M.user_metric(parts, "merged").collect()[0]
    assert (batch.total_comments, batch.toxic_count, batch.version) == (1, 1, 1)
    assert (merged.total_comments, merged.toxic_count, merged.version) == (3, 1, 2)
    assert merged.author_name == "name_a_1"          # latest batch wins


def test_rounding_f8(spark):
    rows = [_c(i, f"u{i}", 0.95 if i == 0 else 0.1, 0, secs=i) for i in range(16)]
    parts = stream_metric_partials(_rows(spark, rows), keys=["batch_id"])
    assert M.merge_stream_metric(parts).collect()[0].toxic_ratio == 0.063
    assert M.merge_stream_metric(parts, rounding="half_even").collect()[0].toxic_ratio == 0.062


def test_full_outer_equals_rollup(spark):
    c = views.comments(spark, "/root/testdata/sf0.001", with_message=False)
    parts = stream_metric_partials(c, "1 day", keys=["batch_id"])
    state = M.merge_stream_metric(parts.where("batch_id < 6"))
    a = M.merge_full_outer(state, parts.where("batch_id = 6"))
    b = M.merge_stream_metric(parts)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_skip_and_upsert(spark):
    c = views.comments(spark, "/root/testdata/sf0.001", with_message=False)
    ledger = spark.createDataFrame([(0,), (3,)], "batch_id long")
    left = M.skip_processed_batches(c, ledger)
    assert left.where(F.col("batch_id").isin(0, 3)).count() == 0
    assert left.count() == c.where(~F.col("batch_id").isin(0, 3)).count()
    both = c.unionByName(views.replayed(c))
    latest = M.upsert_latest(both, "comment_id", ["batch_id"])
    assert latest.count() == c.count() and latest.agg(F.min("batch_id")).collect()[0][0] >= views.BATCHES
    first = M.first_delivery(both, "comment_id", ["batch_id"])
    assert first.agg(F.max("batch_id")).collect()[0][0] < views.BATCHES


def test_change_feed_ops(spark):
    rows = [_c(1, "a", 0.9, 0), _c(2, "b", 0.1, 2), _c(3, "c", 0.8, 5)]
    feed = M.metric_change_feed(stream_metric_partials(_rows(spark, rows), keys=["batch_id"])).orderBy("batch_id").collect()
    assert [(r.batch_id, r.op, r.total_comments, r.toxic_count) for r in feed] == \
        [(0, "insert", 1, 1), (2, "update", 2, 1), (5, "update", 3, 2)]


def test_approx_counts_within_tolerance(spark):
    c = views.comments(spark, "/root/testdata/sf0.01", with_message=False)
    exact = {r.video_id: r.unique_viewers for r in unique_viewers(c, None, method="exact").collect()}
    approx = {r.video_id: r.unique_viewers for r in unique_viewers(c, None, method="approx").collect()}
    parts = stream_metric_partials(c, "1 day", keys=["batch_id"], sketch=True)
    merged = {r.video_id: r for r in unique_viewers_merged(parts).collect()}
    for v, n in exact.items():
        assert abs(approx[v] - n) <= 3 * 0.01 * n + 1
        assert abs(merged[v].unique_viewers - n) <= 3 * 0.01 * n + 1
        assert merged[v].unique_viewers_additive >= merged[v].unique_viewers


@pytest.mark.parametrize("viewers", ["sketch", "approx", "exact"])
def test_viewer_modes_agree_on_small_groups(spark, viewers):
    rows = [_c(i, f"u{i % 4}", 0.1, 0, secs=i) for i in range(12)]
    r = stream_metric_partials(_rows(spark, rows), viewers=viewers).collect()[0]
    assert r.unique_viewers == 4


def test_merge_properties_random_batches(spark):
    """For random comments over random batches: merged partials equal a one-shot
    aggregate, version counts the batches, and folding a subset first (as
    compaction does) changes nothing."""
    from hypothesis import HealthCheck, given, settings, strategies as st

    comment = st.tuples(st.sampled_from("abcde"), st.sampled_from([0.1, 0.5, 0.7, 0.9]), st.integers(0, 3),
                        st.integers(0, 400), st.sampled_from(["v1", "v2"]))

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(comment, min_size=1, max_size=30), st.sets(st.integers(0, 3)))
    def check(rows, folded_batches):
        df = _rows(spark, [_c(i, a, s, b, secs, v) for i, (a, s, b, secs, v) in enumerate(rows)])
        parts = stream_metric_partials(df, keys=["batch_id"])
        merged = {(r.video_id, r.window_start): (r.total_comments, r.toxic_count, r.version)
                  for r in M.merge_stream_metric(parts).collect()}
        direct = {(r.video_id, r.window_start): (r.total_comments, r.toxic_count)
                  for r in stream_metric_partials(df).collect()}
        batches = {}
        for a, s, b, secs, v in rows:
            key = (v, (T0 + dt.timedelta(seconds=secs)).replace(second=0))
            batches.setdefault(key, set()).add(b)
        assert {k: m[:2] for k, m in merged.items()} == direct
        assert {k: m[2] for k, m in merged.items()} == {k: len(b) for k, b in batches.items()}
        # fold some batches into a snapshot row per key, then merge with the rest
        inside = F.col("batch_id").isin(*folded_batches) if folded_batches else F.lit(False)
        snap = M.merge_stream_metric(parts.where(inside)).withColumn("batch_id", F.lit(-1).cast("long"))
        rest = parts.where(~inside).withColumn("version", F.lit(1).cast("long"))
        again = {(r.video_id, r.window_start): (r.total_comments, r.toxic_count, r.version)
                 for r in M.merge_stream_metric(snap.unionByName(rest, allowMissingColumns=True)).collect()}
        assert again == merged

    check()


def test_full_outer_merge_matches_null_keys(spark):
    from chatmod.operators.merge import merge_full_outer, merge_stream_metric
    ddl = "video_id string, window_start long, window_end long, total_comments long, toxic_count long, unique_viewers long, batch_id long"
    rows = [(v, w, 1, 2, 1, 1, b) for v in (None, "a") for w in (None, 5) for b in (0, 1)]
    parts = spark.createDataFrame(rows, ddl)
    step = merge_full_outer(merge_stream_metric(parts.where("batch_id = 0")), parts.where("batch_id = 1"))
    assert sorted(step.collect(), key=repr) == sorted(merge_stream_metric(parts).collect(), key=repr)
