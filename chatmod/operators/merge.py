"""Cross-batch merges of partial aggregates, upserts, replay skipping, change feeds.

The per-batch partials of the metric tables are additive, so the merged table
is a ``groupBy(key)`` rollup over all partials (map-side combined); no state
has to be read back, and a replayed batch that overwrote its own partial is
counted once. Each partial row carries ``batch_id`` (and optionally
``version`` = number of batches folded into it, 1 when absent).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmod.operators.metrics import ratio
from chatmod.session import bounded_broadcast

STREAM_KEY = ["video_id", "window_start"]
USER_KEY = ["video_id", "author_id", "window_start"]
LEDGER_BROADCAST_ROWS = 100_000


def present(*cols: str) -> Column:
    """Every key column set: not null and not empty (change events without their
    video — or author — id reach no dashboard)."""
    cond = None
    for c in cols:
        ok = F.col(c).isNotNull() & (F.col(c) != "")
        cond = ok if cond is None else cond & ok
    return cond


def _version(df: DataFrame) -> Column:
    return F.coalesce(F.col("version"), F.lit(1)) if "version" in df.columns else F.lit(1)


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def merge_stream_metric(partials: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Merged per-minute channel metrics from per-batch partials.

    Counts add up (``unique_viewers`` too: an author seen in two batches of a
    window counts twice, as the additive upsert does; the sketch column, when
    present, gives ``unique_viewers_merged`` without that bias). ``version`` =
    batches merged; the ratio is recomputed from the merged counts.
    """
    aggs = [
        F.max("window_end").alias("window_end"),
        _sum0("total_comments").alias("total_comments"),
        _sum0("toxic_count").alias("toxic_count"),
        _sum0("unique_viewers").alias("unique_viewers"),
        F.sum(_version(partials)).cast("long").alias("version"),
    ]
    has_sketch = "unique_viewers_sketch" in partials.columns
    if has_sketch:
        aggs.append(F.hll_union_agg("unique_viewers_sketch", True).alias("unique_viewers_sketch"))
    out = partials.groupBy(*STREAM_KEY).agg(*aggs)
    cols = [*STREAM_KEY, "window_end", "total_comments", "toxic_count", "unique_viewers",
            ratio(F.col("toxic_count"), F.col("total_comments"), rounding).alias("toxic_ratio"), "version"]
    if has_sketch:
        cols += ["unique_viewers_sketch",
                 F.hll_sketch_estimate("unique_viewers_sketch").alias("unique_viewers_merged")]
    return out.select(*cols)


def merge_user_metric(partials: DataFrame, rounding: str = "half_up", order_col: str = "batch_id") -> DataFrame:
    """Merged per-minute author metrics: counts add, name / image from the latest
    batch (``max_by`` on the batch id), last violation = max."""
    out = partials.groupBy(*USER_KEY).agg(
        F.max("window_end").alias("window_end"),
        F.max_by("author_name", order_col).alias("author_name"),
        F.max_by("author_image", order_col).alias("author_image"),
        _sum0("total_comments").alias("total_comments"),
        _sum0("toxic_count").alias("toxic_count"),
        F.max("last_violation_time").alias("last_violation_time"),
        F.sum(_version(partials)).cast("long").alias("version"),
    )
    return out.select(
        "video_id", "author_id", "author_name", "author_image", "total_comments", "toxic_count",
        "last_violation_time", ratio(F.col("toxic_count"), F.col("total_comments"), rounding).alias("toxic_ratio"),
        "window_start", "window_end", "version",
    )


def user_metric(partials_unfiltered: DataFrame, filter_scope: str = "batch", rounding: str = "half_up") -> DataFrame:
    """Merged author metrics with the toxic filter applied per batch (``"batch"``,
    drops a batch's clean rows before the merge) or after the merge (``"merged"``).

    ``partials_unfiltered`` must come from ``user_metric_partials(only_toxic=False)``.
    """
    if filter_scope == "batch":
        return merge_user_metric(partials_unfiltered.where(F.col("toxic_count") > 0), rounding)
    merged = merge_user_metric(partials_unfiltered, rounding)
    return merged.where(F.col("toxic_count") > 0)


def merge_full_outer(state: DataFrame, batch: DataFrame, rounding: str = "half_up") -> DataFrame:
    """One keyed upsert step of the stream metric: merged state ⟗ one batch's partials.

    New keys are inserted with version 1; existing keys add the batch's counts
    and bump the version. Equals ``merge_stream_metric`` over all partials.
    """
    s, b = state.alias("s"), batch.alias("b")
    same_key = F.col(f"s.{STREAM_KEY[0]}").eqNullSafe(F.col(f"b.{STREAM_KEY[0]}"))
    for k in STREAM_KEY[1:]:
        same_key &= F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = s.join(b, same_key, how="full")
    keys = [F.coalesce(f"b.{k}", f"s.{k}").alias(k) for k in STREAM_KEY]

    def add(c: str) -> Column:
        return (F.coalesce(F.col(f"s.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))).cast("long")

    out = joined.select(
        *keys,
        F.coalesce(F.col("b.window_end"), F.col("s.window_end")).alias("window_end"),
        add("total_comments").alias("total_comments"),
        add("toxic_count").alias("toxic_count"),
        add("unique_viewers").alias("unique_viewers"),
        (F.coalesce(F.col("s.version"), F.lit(0))
         + F.when(F.col("b.total_comments").isNotNull(), 1).otherwise(0)).cast("long").alias("version"),
    )
    return out.select(*STREAM_KEY, "window_end", "total_comments", "toxic_count", "unique_viewers",
                      ratio(F.col("toxic_count"), F.col("total_comments"), rounding).alias("toxic_ratio"), "version")


def skip_processed_batches(df: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Rows of batches not yet in the ledger (anti-join on the batch identity).

    The ledger holds one row per processed batch; it is broadcast when it
    really is small, so a batch holding a third of the rows is not funnelled
    into one shuffle partition. Beyond the bound, AQE's skew-join split handles it.
    """
    keys = list(keys)
    return df.join(bounded_broadcast(ledger.select(*keys).distinct(), LEDGER_BROADCAST_ROWS), on=keys,
                   how="left_anti")


def upsert_latest(df: DataFrame, key: str = "comment_id", order_cols: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Replace-by-key: the latest version of each key (by ``order_cols``).

    Written as an aggregate (``max_by`` of the whole row), so duplicates are
    combined map-side before the shuffle on the (unique, unskewed) key.
    """
    cols = [c for c in df.columns]
    order = F.struct(*[F.col(c) for c in order_cols])
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r"))
              .select("r.*"))


def first_delivery(df: DataFrame, key: str = "comment_id", order_cols: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The first version of each key — the rows an insert-only change feed emits."""
    cols = [c for c in df.columns]
    order = F.struct(*[F.col(c) for c in order_cols])
    return (df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r"))
              .select("r.*"))


def metric_change_feed(partials: DataFrame, key: Sequence[str] = STREAM_KEY,
                       additive: Sequence[str] = ("total_comments", "toxic_count", "unique_viewers"),
                       ops: Sequence[str] = ("insert", "update", "replace")) -> DataFrame:
    """Change events of a merged table, one per (batch, key) the batch touched.

    ``op`` = ``insert`` for the key's first batch, else ``update``; values are
    the merged totals as of that batch (running sums over the key's partials).
    The window per key holds at most one row per batch, whatever the data size.
    Rows with a null or empty video id are dropped (the feed's key guard).
    """
    key = list(key)
    order = ["batch_id", *[c for c in ("stream_id",) if c in partials.columns]]   # one order over all streams
    w = Window.partitionBy(*key).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = partials.select(
        "batch_id", *key,
        F.when(F.row_number().over(w) == 1, F.lit("insert")).otherwise(F.lit("update")).alias("op"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(running).cast("long").alias(c) for c in additive],
    )
    return out.where(F.col("op").isin(*ops) & present("video_id"))
