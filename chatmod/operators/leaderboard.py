"""Emit-on-change leaderboards over a sequence of batches, without all-pairs expansion.

The board of a video after batch ``b`` is the top ``k`` authors by their running
toxic total up to ``b``. An author's running total is a step function: value
``cum`` on the batch interval ``[s, e)`` between two of its changes. Listing
every (batch, author) pair is quadratic, so instead each interval is cut into
its canonical dyadic pieces (a segment tree over batch ids: at most two nodes
per level). Every node keeps only its ``k`` best intervals — a per-node top-k
that Spark plans with a map-side ``WindowGroupLimit`` — and the board at ``b``
is the top ``k`` over the ``O(log B)`` nodes on the path from leaf ``b`` to the
root. This is exact: every interval on that path covers ``b``, each author has
at most one interval covering ``b``, and an author in the true top ``k`` at
``b`` is within the top ``k`` of its own node. Work is ``O(changes · log B)``;
every shuffle is keyed by (video, author), (video, level, node) or (video,
batch), never by the video alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.operators.merge import present
from chatmod.session import shared_dir


def _bit_length(x: Column) -> Column:
    return F.length(F.bin(x))


def _shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def _cover_nodes(s: Column, e: Column) -> Column:
    """Array of (lvl, node) structs: the maximal dyadic intervals inside ``[s, e)``."""
    levels = F.sequence(F.lit(0), _bit_length(e - s) - 1)

    def per_level(lvl: Column) -> Column:
        size = _shl(F.lit(1).cast("long"), lvl)
        left = _shr(s + size - 1, lvl)
        right = _shr(e, lvl) - 1
        return F.transform(F.array_distinct(F.array(left, right)),
                           lambda j: F.struct(lvl.alias("lvl"), j.alias("node")))

    def keep(n: Column) -> Column:
        size = _shl(F.lit(1).cast("long"), n["lvl"])
        start, end = n["node"] * size, (n["node"] + 1) * size
        parent = _shr(n["node"], F.lit(1))
        pstart, pend = parent * size * 2, (parent + 1) * size * 2
        inside = (start >= s) & (end <= e)
        parent_inside = (pstart >= s) & (pend <= e)
        return inside & ~parent_inside

    return F.filter(F.flatten(F.transform(levels, per_level)), keep)


def _checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def board_string(author: Column, total: Column) -> Column:
    return F.concat(author, F.lit(":"), total.cast("string"))


def leaderboard_changes(deltas: DataFrame, k: int = S.LEADERBOARD_SIZE, key: str = "video_id",
                        item: str = "author_id", value: str = "toxic_count", seq: str = "batch_id",
                        checkpoint: bool = True) -> DataFrame:
    """Boards that differ from the previous board of the same video.

    ``deltas``: rows (video, author, batch, count) — e.g. per-batch user metric
    partials; rows without a video id, author id or batch id belong to no board. Boards are evaluated at the batches where the video changed; the
    first board of a video is always emitted. Output: ``video_id, batch_id,
    leaderboard`` where the board is ``author:total`` joined by commas, rank order
    (total desc, author asc). ``checkpoint``: write the per-batch deltas once to
    the shared checkpoint folder (``spark.checkpoint.dir``), so the input is read
    once although every branch of the plan uses the deltas.
    """
    # explicit null guards: every branch below then carries the same filters, so
    # Spark reuses one exchange for ``d`` instead of recomputing it per branch
    d = (deltas.where(present(key, item) & F.col(seq).isNotNull())
               .groupBy(key, item, seq)
               .agg(F.sum(value).cast("long").alias("delta"))
               .where(F.col("delta") != 0))
    if checkpoint:
        # every branch below reads the deltas: write them once to the shared
        # checkpoint folder instead of re-reading the input per branch
        d = _checkpointed(d)
    end = d.select((F.max(seq) + 1).alias("b_end")).scalar()

    per_item = Window.partitionBy(key, item).orderBy(seq)
    intervals = d.select(
        key, item,
        F.col(seq).alias("s"),
        F.coalesce(F.lead(seq).over(per_item), end).alias("e"),
        F.sum("delta").over(per_item.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"),
    )
    order = [F.col("cum").desc(), F.col(item).asc()]
    nodes = (intervals
             .select(key, item, "cum", F.explode(_cover_nodes(F.col("s"), F.col("e"))).alias("n"))
             .select(key, item, "cum", F.col("n.lvl").alias("lvl"), F.col("n.node").alias("node")))
    node_top = (nodes.withColumn("r", F.row_number().over(Window.partitionBy(key, "lvl", "node").orderBy(*order)))
                     .where(F.col("r") <= k).drop("r"))

    # Boards are needed at each change point b and just before it (b - 1): nothing
    # changes for the video in between, so the board at b - 1 is the previous
    # board. Comparing the two is a join on (video, batch), not a window over a video.
    points = d.select(key, seq).distinct()
    leaves = points.select(key, F.col(seq).alias("leaf")).unionByName(
        points.select(key, (F.col(seq) - 1).alias("leaf"))).distinct()
    path = (leaves
            .select(key, "leaf", F.explode(F.sequence(F.lit(0), _bit_length(end))).alias("lvl"))
            .withColumn("node", _shr(F.col("leaf"), F.col("lvl"))))
    cand = path.join(node_top, on=[key, "lvl", "node"], how="inner")
    boards = (cand.withColumn("rank", F.row_number().over(Window.partitionBy(key, "leaf").orderBy(*order)))
                  .where(F.col("rank") <= k)
                  .groupBy(key, "leaf")
                  .agg(F.array_sort(F.collect_list(F.struct("rank", board_string(F.col(item), F.col("cum")).alias("t"))))
                       .alias("entries"))
                  .select(key, "leaf", F.array_join(F.transform("entries", lambda x: x["t"]), ",").alias("leaderboard")))
    current = points.join(boards.withColumnRenamed("leaf", seq), on=[key, seq], how="inner")
    previous = boards.select(key, (F.col("leaf") + 1).alias(seq), F.col("leaderboard").alias("previous"))
    return (current.join(previous, on=[key, seq], how="left")
                   .where(F.col("previous").isNull() | (F.col("previous") != F.col("leaderboard")))
                   .select(key, seq, "leaderboard"))
