"""Distinct viewers of any span of time, from a tree of sketches.

Every minute's HLL sketch is also part of the sketch of its two minutes, four minutes, and so on. A span of n minutes is
the union of at most two nodes per level, so it is answered from O(log n) sketches whatever its length, where the
additive counts would have to be recomputed from the rows. The tree is a table keyed by (video, level, node); a hot
video is many nodes. Sketches are merged in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmod.operators.metrics import HLL_LG_K

LEVELS = 21                 # 2^20 minutes: two years under one node
MINUTE = 60


def minute_of(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (MINUTE * 1_000_000)).cast("long")


def minute_sketches(rows: DataFrame, ts_col: str = "kafka_timestamp") -> DataFrame:
    """(video_id, minute, sketch) of the authors seen in each minute."""
    known = rows.where(F.col(ts_col).isNotNull() & F.col("author_id").isNotNull())
    return known.groupBy("video_id", minute_of(F.col(ts_col)).alias("minute")).agg(F.hll_sketch_agg("author_id", HLL_LG_K).alias("sketch"))


def sketch_tree(minutes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(video_id, level, node, sketch): node n of level l covers the minutes n * 2^l to (n + 1) * 2^l - 1.

    Trees of different batches are one tree after ``merge_trees``."""
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.struct(
        l.alias("level"), F.floor(F.col("minute") / F.pow(F.lit(2.0), l)).cast("long").alias("node"))))
    return merge_trees(minutes.select("video_id", above.alias("n"), "sketch").select("video_id", "n.level", "n.node", "sketch"))


def merge_trees(trees: DataFrame) -> DataFrame:
    return trees.groupBy("video_id", "level", "node").agg(F.hll_union_agg("sketch", True).alias("sketch"))


def cover(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The nodes (level, node) that make up the minutes ``first`` to ``last``: at most two of each level below the top."""
    def of_level(l: Column) -> Column:
        size = F.pow(F.lit(2.0), l)
        lo, hi = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")     # whole nodes, lo to hi - 1
        node = lambda at: F.struct(l.alias("level"), at.alias("node"))
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        ends = F.concat(F.when((lo < hi) & odd(lo), F.array(node(lo))).otherwise(none), F.when((lo < hi) & odd(hi), F.array(node(hi - 1))).otherwise(none))
        top = F.when(lo < hi, F.transform(F.sequence(lo, F.greatest(lo, hi - 1)), node)).otherwise(none)
        return F.when(l < levels - 1, ends).otherwise(top)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), of_level))


def viewers_of_spans(tree: DataFrame, spans: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``spans`` (video_id, first, last and any key columns, rows all different) with unique_viewers; 0 without any viewer."""
    keys = spans.columns
    asked = spans.select(*keys, F.explode_outer(cover(F.col("first"), F.col("last"), levels)).alias("n")).select(*keys, "n.level", "n.node")
    found = asked.join(tree, ["video_id", "level", "node"], "left")
    merged = found.groupBy(*keys).agg(F.hll_union_agg("sketch", True).alias("sketch"))
    return merged.select(*keys, F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long").alias("unique_viewers"))
