"""Leaderboards: top-k, share of leader, enrichment, emit-on-change (FIXTURES §5: F11)."""

import random

from chatmod.operators import serving as V
from chatmod.operators.leaderboard import leaderboard_changes

DELTAS = "video_id string, author_id string, batch_id long, toxic_count long"


def brute_force(rows, k=5):
    """Boards per (video, batch) by replaying batches in order; emit on change."""
    out, prev = [], {}
    for video in sorted({r[0] for r in rows}):
        totals = {}
        for b in sorted({r[2] for r in rows if r[0] == video}):
            for v, a, bb, c in rows:
                if v == video and bb == b:
                    totals[a] = totals.get(a, 0) + c
            top = sorted(((-t, a) for a, t in totals.items() if t != 0))[:k]
            board = ",".join(f"{a}:{-t}" for t, a in top)
            if prev.get(video) != board:
                out.append((video, b, board))
            prev[video] = board
    return sorted(out)


def test_changes_match_brute_force_many_batches(spark):
    rng = random.Random(7)
    rows = []
    for video in ["v1", "v2", "v3"]:
        for b in range(40):
            if rng.random() < 0.7:
                for a in rng.sample(range(15), rng.randint(1, 4)):
                    rows.append((video, f"a{a:02d}", b + rng.choice([0, 0, 100]), rng.randint(1, 3)))
    df = spark.createDataFrame(rows, DELTAS)
    got = sorted(tuple(r) for r in leaderboard_changes(df).collect())
    assert got == brute_force(rows)


def test_unchanged_top5_not_emitted_f11(spark):
    first = [("v", f"a{i}", 0, 10 - i) for i in range(6)]        # a0..a4 lead, a5 sixth with 5
    second = [("v", "a5", 1, 0 + 1)]                                # a5 → 6, still below a4 (6)? tie → a4 first
    df = spark.createDataFrame(first + second, DELTAS)
    got = leaderboard_changes(df).collect()
    assert [(r.batch_id) for r in got] == [0]
    third = [("v", "a5", 2, 5)]                                     # a5 → 11: new leader
    got = leaderboard_changes(spark.createDataFrame(first + second + third, DELTAS)).collect()
    assert [r.batch_id for r in got] == [0, 2] and got[1].leaderboard.startswith("a5:11")


def test_top_k_share_and_enrich(spark):
    totals = spark.createDataFrame(
        [("v", "a", "A", "ia", 4), ("v", "b", "B", "", 4), ("v", "c", "C", "", 2), ("w", "z", "Z", "", 0)],
        "video_id string, author_id string, author_name string, author_image string, toxic_count long")
    top = V.top_authors_all(totals, k=2)
    view = {(r.video_id, r.author_id): r for r in V.leaderboard_view(top).collect()}
    assert view[("v", "a")].rank == 1 and view[("v", "b")].rank == 2 and ("v", "c") not in view
    assert view[("v", "b")].share_pct == 100.0 and view[("w", "z")].share_pct == 0.0
    assert view[("v", "a")].rank_label == "#1"
    authors = spark.createDataFrame([("a", "Ann", ""), ("b", "", "img")], "author_id string, name string, avatar string")
    rich = {r.author_id: r for r in V.enrich_leaderboard(top, authors).collect()}
    assert (rich["a"].author_name, rich["a"].author_image) == ("Ann", "")
    assert (rich["b"].author_name, rich["b"].author_image) == ("Unknown", "img")
    assert (rich["z"].author_name, rich["z"].author_image) == ("Unknown", "")
    assert [r.author_id for r in V.top_authors(totals, "v", k=2).collect()] == ["a", "b"]


def test_rows_without_video_or_author_reach_no_board(spark):
    from chatmod.operators.leaderboard import leaderboard_changes
    from pyspark.sql import functions as F

    from chatmod.streaming.leaderboards import toxic_totals

    deltas = spark.createDataFrame(
        [("v", "a", 0, 1), ("v", "", 0, 9), ("v", None, 0, 9), ("", "b", 0, 9), (None, "b", 0, 9)],
        "video_id string, author_id string, batch_id long, toxic_count long")
    assert [(r.video_id, r.leaderboard) for r in leaderboard_changes(deltas, checkpoint=False).collect()] == [("v", "a:1")]
    scored = deltas.withColumn("toxic_score", F.lit(0.95))
    assert [(r.video_id, r.author_id) for r in toxic_totals(scored).collect()] == [("v", "a")]
