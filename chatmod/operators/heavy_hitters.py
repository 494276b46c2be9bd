"""The exact top authors of every video without shuffling every author.

First pass: every task summarises its rows in at most ``SUMMARY`` counters per video (Misra-Gries in its mergeable
form: when there are more, the next largest count is taken off all). A counter falls short of the truth by at most
the summary's ``error``. Only the counters are shuffled; added up they bound every author's total from below, and from
above with the errors of all summaries of the video. Authors whose upper bound reaches the k-th largest lower bound are
candidates; all others are provably behind. Second pass: exact totals of the candidates only.

Where the errors reach the k-th lower bound, an author in no summary could be in the top k; those videos (many authors
of like counts) are counted in full, so the answer is exact whatever the data.

A video of a third of all rows costs ``SUMMARY`` counters per task. Rows without video or author are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.operators.merge import present
from chatmod.operators.serving import leader_order
from chatmod.session import bounded_broadcast, shared_dir

SUMMARY = 64                    # counters per video and task
CANDIDATES_BROADCAST_ROWS = 200_000
ROWS_HELD = 1 << 17             # counters a task holds before it shortens them


def _shorten(table: pa.Table, size: int) -> pa.Table:
    """At most ``size`` counters of every video; ``error`` grows by what is taken off."""
    table = table.group_by(["video_id", "author_id"]).aggregate([("n", "sum")]).rename_columns(["video_id", "author_id", "n"])
    table = table.sort_by([("video_id", "ascending"), ("n", "descending"), ("author_id", "ascending")])
    video = table.column("video_id").combine_chunks().dictionary_encode()
    code, n = np.array(video.indices), np.array(table.column("n"), np.int64)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    count = np.diff(first, append=len(code))
    cut = np.where(count > size, n[np.minimum(first + size, len(n) - 1)], 0) if len(n) else np.zeros(0, np.int64)
    left = n - np.repeat(cut, count)
    kept = left > 0
    out = table.set_column(2, "n", pa.array(left)).filter(pa.array(kept))
    errors = pa.table({"video_id": table.column("video_id").take(pa.array(first)), "author_id": pa.nulls(len(first), pa.string()), "n": cut})
    return pa.concat_tables([out, errors.filter(pa.array(cut > 0))])


def author_summaries(counts: DataFrame, size: int = SUMMARY) -> DataFrame:
    """Per task (video_id, author_id, n): counters, and one row per video with author null whose n is the error."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("video_id", pa.string()), ("author_id", pa.string()), ("n", pa.int64())])
        held, errors = schema.empty_table(), schema.empty_table()

        def shorten() -> None:
            nonlocal held, errors
            both = _shorten(held, size)
            held = both.drop_null()
            errors = pa.concat_tables([errors, both.filter(both.column("author_id").is_null())]).group_by("video_id").aggregate([("n", "sum")]).rename_columns(["video_id", "n"])
            errors = errors.add_column(1, "author_id", pa.nulls(errors.num_rows, pa.string())).select(schema.names)

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(schema)])
            if held.num_rows > ROWS_HELD:
                shorten()
        if held.num_rows:
            shorten()
        for table in (held, errors):
            yield from table.cast(schema).to_batches()

    return counts.mapInArrow(summarise, "video_id string, author_id string, n long")


def candidates(summaries: DataFrame, k: int = S.LEADERBOARD_SIZE) -> tuple[DataFrame, DataFrame]:
    """(video_id, author_id) of all that can be in a top ``k``, and (video_id) of the videos whose summaries cannot tell."""
    lower = summaries.where("author_id is not null").groupBy("video_id", "author_id").agg(F.sum("n").alias("n"))
    error = summaries.where("author_id is null").groupBy("video_id").agg(F.sum("n").alias("error"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n"), "author_id"))
    limit = lower.withColumn("place", place).where(F.col("place") <= k).groupBy("video_id").agg(
        F.min("n").alias("limit"), F.count(F.lit(1)).alias("of"))
    bounds = limit.join(error, "video_id", "left").withColumn("error", F.coalesce("error", F.lit(0)))
    # fewer than k counters, or errors as large as the k-th: an author in no summary may belong to the top
    unsure = (F.col("error") > 0) & ((F.col("of") < k) | (F.col("error") >= F.col("limit")))
    missed = error.join(limit, "video_id", "left_anti").select("video_id")
    sure = lower.join(bounds.where(~unsure), "video_id").where(F.col("n") + F.col("error") >= F.col("limit"))
    return sure.select("video_id", "author_id"), bounds.where(unsure).select("video_id").unionByName(missed)


def top_authors_two_pass(user_metrics: DataFrame, k: int = S.LEADERBOARD_SIZE, size: int = SUMMARY) -> DataFrame:
    """``serving.top_authors_all`` of the author totals: (video_id, rank, author_id, author_name, author_image, toxic_count)."""
    rows = user_metrics.where(present("video_id", "author_id"))
    counts = rows.select("video_id", "author_id", F.col("toxic_count").cast("long").alias("n")).where("n > 0")
    shared_dir(user_metrics.sparkSession)
    keys, unsure = candidates(author_summaries(counts, size).checkpoint(), k)       # a few counters per task
    keys = bounded_broadcast(keys, CANDIDATES_BROADCAST_ROWS)
    columns = ["video_id", "author_id", "author_name", "author_image", "toxic_count"]
    named = rows.select(*columns)
    kept = named.join(keys, ["video_id", "author_id"], "left_semi").unionByName(
        named.join(bounded_broadcast(unsure, CANDIDATES_BROADCAST_ROWS), "video_id", "left_semi"))
    totals = kept.groupBy("video_id", "author_id").agg(F.max("author_name").alias("author_name"), F.max("author_image").alias("author_image"),
                                                       F.sum("toxic_count").cast("long").alias("toxic_count"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(*leader_order()))
    return totals.withColumn("rank", rank).where(F.col("rank") <= k).select("video_id", "rank", "author_id", "author_name", "author_image", "toxic_count")
