"""Batch-partitioned tables of partial aggregates, and their merged views.

Layout under a shared root (``spark.checkpoint.dir`` by default)::

    <root>/<table>/stream_id=<query id>/batch_id=<n>/part-*.parquet   partials
    <root>/<table>__snapshot/snap=<k>/part-*.parquet                  compacted rows
    <root>/<table>__folded/snap=<k>/part-*.parquet                    (stream_id, max batch folded)

Writing a batch replaces only its own ``(stream_id, batch_id)`` partition
(dynamic partition overwrite), so a replayed batch is counted once, late rows
just add a partial, and nothing passes through the driver. Readers roll the
partials up by key; ``compact`` folds everything written so far into a snapshot
so reads stay cheap as batches accumulate. A snapshot counts only once its
ledger entry exists (written after the snapshot), so a crash mid-compaction
leaves the previous state readable. Once snapshot ``k`` is committed, the
partials folded by snapshot ``k - 1`` and the snapshots before ``k - 1`` are
deleted: the number of directories a reader lists stays bounded by one
compaction interval instead of growing with every batch ever written, and a
reader that listed files before the previous compaction still finds them.
Change feeds cover the batches that are still kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.operators import merge as M
from chatmod.operators import serving as V
from chatmod.session import bounded_broadcast, shared_dir

LEDGER_BROADCAST_ROWS = 100_000  # snapshot ledger: one row per stream

TABLES = ("comments", "stream_metric", "user_metric")

# Within each written file rows are sorted by these columns (a per-task sort, no
# shuffle), so Parquet row-group min/max statistics let a video filter skip data.
SORT_KEYS = {
    "comments": ["video_id", "published_at"],
    "stream_metric": ["video_id", "window_start"],
    "user_metric": ["video_id", "author_id", "window_start"],
}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _subdirs(spark: SparkSession, path: str, prefix: str) -> list[tuple[str, str]]:
    """(value, full path) of the ``prefix=value`` directories under ``path`` (metadata only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(prefix + "="):
            out.append((name[len(prefix) + 1:], st.getPath().toString()))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class PartialStore:
    def __init__(self, spark: SparkSession, root: str | None = None, user_filter_scope: str = "batch"):
        """``user_filter_scope``: ``"batch"`` drops an author's clean rows of a batch
        before the merge (as the additive upsert does); ``"merged"`` keeps every
        partial and filters the merged rows."""
        self.spark = spark
        self.root = root or shared_dir(spark, "chatmod-store")
        self.user_filter_scope = user_filter_scope

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # -- writing -------------------------------------------------------------
    def write(self, df: DataFrame, table: str, stream_id: str, batch_id: int) -> None:
        """Replace the partial of one (stream, batch)."""
        keys = [k for k in SORT_KEYS.get(table, []) if k in df.columns]
        if keys:
            df = df.sortWithinPartitions(*keys)
        (df.withColumn("written_at", F.current_timestamp())
           .withColumn("stream_id", F.lit(stream_id))
           .withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
           .write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic")
           .partitionBy("stream_id", "batch_id")
           .parquet(self.path(table)))

    # a batch as ``process_batch`` writes it; ``VersionedStore`` commits batches and skips what was counted
    def begin(self, stream_id: str, batch_id: int) -> "PartialStore | None":
        return self

    def fresh(self, batch: DataFrame) -> DataFrame:
        return batch

    def record(self, batch: DataFrame) -> None:
        pass

    def commit(self) -> int | None:
        return None

    # -- reading -------------------------------------------------------------
    def _snapshots(self, table: str) -> list[int]:
        """Numbers of the snapshots kept, newest first."""
        if not _exists(self.spark, self.path(f"{table}__folded")):
            return []
        found = _subdirs(self.spark, self.path(f"{table}__folded"), "snap")
        return sorted((int(v) for v, _ in found if v.isdigit()), reverse=True)

    def _snapshot(self, table: str, snap: int) -> tuple[DataFrame, DataFrame]:
        """Rows of a snapshot, and the highest batch it folded per stream."""
        folded = self.spark.read.parquet(self.path(f"{table}__folded")).where(F.col("snap") == snap)
        rows = self.spark.read.parquet(self.path(f"{table}__snapshot")).where(F.col("snap") == snap).drop("snap")
        return rows, folded.select("stream_id", "max_batch_id")

    def raw(self, table: str) -> DataFrame | None:
        """All partial files of a table, listed once (the listing is fixed from here on);
        None when there are none (never written, or all folded and retired)."""
        if not _exists(self.spark, self.path(table)):
            return None
        try:
            return self.spark.read.parquet(self.path(table))
        except AnalysisException as e:  # only empty partition folders are left
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def partials(self, table: str, raw: DataFrame | None = None) -> DataFrame | None:
        """Current partial rows: the latest snapshot plus partials written after it."""
        parts = raw if raw is not None else self.raw(table)
        snaps = self._snapshots(table)
        return self._with_base(parts, *self._snapshot(table, snaps[0])) if snaps else parts

    @staticmethod
    def _newer(parts: DataFrame, folded: DataFrame) -> DataFrame:
        # the ledger has one row per stream; broadcast after checking that bound
        return (parts.join(bounded_broadcast(folded, LEDGER_BROADCAST_ROWS), on="stream_id", how="left")
                     .where(F.col("max_batch_id").isNull() | (F.col("batch_id") > F.col("max_batch_id")))
                     .drop("max_batch_id"))

    def _with_base(self, parts: DataFrame | None, snap: DataFrame, folded: DataFrame) -> DataFrame:
        return snap if parts is None else self._newer(parts, folded).unionByName(snap, allowMissingColumns=True)

    def _feed(self, table: str, since_batch: int, stream_id: str | None) -> tuple[DataFrame | None, DataFrame | None]:
        """(base, newer) for a feed after ``since_batch``: the newest snapshot that folded no later batch, and
        the partials after it. Raises if the batches after ``since_batch`` are folded away already."""
        raw = self.raw(table)
        snaps = self._snapshots(table)
        own = F.lit(True) if stream_id is None else F.col("stream_id") == stream_id
        for snap in snaps:
            rows, folded = self._snapshot(table, snap)
            last = folded.where(own).agg(F.max("max_batch_id")).first()[0]
            if last is None or last <= since_batch:
                return rows.where(own), None if raw is None else self._newer(raw, folded).where(own)
        if len(snaps) > 1:      # what the oldest snapshot kept folded has been deleted
            raise ValueError(f"batches after {since_batch} are folded into snapshots; read the table and follow it from batch {last}")
        return None, None if raw is None else raw.where(own)

    def _video(self, table: str, video_id: str | None) -> DataFrame:
        parts = self.partials(table)
        return parts if video_id is None else parts.where(F.col("video_id") == video_id)

    def stream_metric(self, rounding: str = "half_up", video_id: str | None = None) -> DataFrame:
        return M.merge_stream_metric(self._video("stream_metric", video_id), rounding)

    def user_metric(self, rounding: str = "half_up", video_id: str | None = None) -> DataFrame:
        merged = M.merge_user_metric(self._video("user_metric", video_id), rounding, order_col="written_at")
        return merged.where(F.col("toxic_count") > 0)

    def comments(self, video_id: str | None = None) -> DataFrame:
        """Comment table after replace-by-id upserts (latest write wins).

        A comment never changes video, so the video filter is applied to the
        partials first and reaches the Parquet scan."""
        return M.upsert_latest(self._video("comments", video_id), "comment_id", ["written_at", "batch_id"])

    # -- serving snapshots: top-k keys first, then merge only their partials ----
    def _newest_keys(self, parts: DataFrame, order: list, k: int, partition: str = "video_id") -> DataFrame:
        """Every partial row of the ``k`` newest keys per video. ``dense_rank`` gives
        all versions of a key the same rank, and Spark applies ``rank <= k`` as a
        partial limit in each task before the shuffle, so a hot video ships at most
        k keys' versions per task instead of its whole history."""
        w = Window.partitionBy(partition).orderBy(*order)
        return parts.withColumn("__key_rank", F.dense_rank().over(w)).where(F.col("__key_rank") <= k).drop("__key_rank")

    def latest_comments(self, video_id: str | None, k: int = S.LATEST_COMMENTS_LIMIT) -> DataFrame:
        """The newest ``k`` comments of a video after upserts, served fields only.

        Equal to ``serving.latest_comments(self.comments(video_id), video_id, k)``
        because a comment keeps its id, video and publish time in every version
        (redeliveries of one chat message); only the versions of the k newest
        comments are merged."""
        order = [F.col("published_at").desc(), F.col("comment_id").desc()]
        newest = self._newest_keys(self._video("comments", video_id), order, k)
        latest = M.upsert_latest(newest, "comment_id", ["written_at", "batch_id"])
        return V.latest_comments(latest, video_id, k)

    def recent_windows(self, video_id: str | None, k: int = S.RECENT_WINDOWS_LIMIT,
                       rounding: str = "half_up") -> DataFrame:
        """The latest ``k`` merged windows of a video (oldest first); only the
        partials of those windows are merged (window starts never change)."""
        newest = self._newest_keys(self._video("stream_metric", video_id), [F.col("window_start").desc()], k)
        return V.recent_windows(M.merge_stream_metric(newest, rounding), video_id, k)

    # -- change feeds (snapshot, then changes) ---------------------------------
    def metric_changes(self, since_batch: int = -1, stream_id: str | None = None,
                       video_id: str | None = None) -> DataFrame:
        """Channel-metric change events (insert / update, merged values) of the
        batches after ``since_batch`` (of one stream, or of all in the order batch, stream)."""
        base, newer = self._feed("stream_metric", since_batch, stream_id)
        parts = newer if base is None else base if newer is None else newer.unionByName(base, allowMissingColumns=True)
        if video_id is not None:
            parts = parts.where(F.col("video_id") == video_id)
        return M.metric_change_feed(parts).where(F.col("batch_id") > since_batch)

    def comment_inserts(self, since_batch: int = -1, stream_id: str | None = None,
                        video_id: str | None = None) -> DataFrame:
        """First deliveries of comments in the batches after ``since_batch`` (the insert-only feed)."""
        base, newer = self._feed("comments", since_batch, stream_id)
        parts = newer if newer is not None else base.limit(0)
        if base is not None and newer is not None:
            parts = newer.join(base.select("comment_id"), "comment_id", "left_anti")
        if video_id is not None:
            parts = parts.where(F.col("video_id") == video_id)
        first = M.first_delivery(parts, "comment_id", ["written_at", "batch_id"])
        return first.where((F.col("batch_id") > since_batch) & M.present("video_id"))

    # -- compaction ----------------------------------------------------------
    def compact(self, table: str, snap: int) -> None:
        """Fold every partial written so far into snapshot ``snap``: one row per stream and key, with the
        last batch that touched it, so change feeds can go on from it."""
        raw = self.raw(table)
        if raw is None:
            return
        parts = self.partials(table, raw)
        # Same file listing as the rows folded below, so a batch landing meanwhile
        # is neither lost nor counted twice.
        folded = raw.groupBy("stream_id").agg(F.max("batch_id").alias("max_batch_id"))
        if table == "stream_metric":
            key, extra = M.STREAM_KEY, [F.hll_union_agg("unique_viewers_sketch", True).alias("unique_viewers_sketch")] \
                if "unique_viewers_sketch" in parts.columns else []
            rows = parts.groupBy("stream_id", *key).agg(
                F.max("batch_id").alias("batch_id"),
                F.max("window_end").alias("window_end"),
                F.sum("total_comments").cast("long").alias("total_comments"),
                F.sum("toxic_count").cast("long").alias("toxic_count"),
                F.sum("unique_viewers").cast("long").alias("unique_viewers"),
                F.sum(F.coalesce(F.col("version"), F.lit(1)) if "version" in parts.columns else F.lit(1))
                 .cast("long").alias("version"),
                F.max("written_at").alias("written_at"), *extra)
        elif table == "user_metric":
            rows = parts.groupBy("stream_id", *M.USER_KEY).agg(
                F.max("batch_id").alias("batch_id"),
                F.max("window_end").alias("window_end"),
                F.max_by("author_name", "written_at").alias("author_name"),
                F.max_by("author_image", "written_at").alias("author_image"),
                F.sum("total_comments").cast("long").alias("total_comments"),
                F.sum("toxic_count").cast("long").alias("toxic_count"),
                F.max("last_violation_time").alias("last_violation_time"),
                F.sum(F.coalesce(F.col("version"), F.lit(1)) if "version" in parts.columns else F.lit(1))
                 .cast("long").alias("version"),
                F.max("written_at").alias("written_at"))
        elif table == "boards":
            # the latest board of each video per stream, with its own stream and
            # batch ids: the previous-board lookup of the next batch needs them
            latest = parts.groupBy("stream_id", "video_id").agg(F.max("batch_id").alias("batch_id"))
            rows = parts.join(latest, on=["stream_id", "video_id", "batch_id"], how="left_semi")
        else:
            latest = F.max_by(F.struct(*parts.columns), F.struct("written_at", "batch_id")).alias("r")
            rows = parts.groupBy("stream_id", "comment_id").agg(latest).select("r.*")
        keys = [k for k in SORT_KEYS.get(table, []) if k in rows.columns]
        if keys:        # row groups that a video filter can skip
            rows = rows.sortWithinPartitions(*keys)
        (rows.withColumn("snap", F.lit(int(snap))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("snap")
             .parquet(self.path(f"{table}__snapshot")))
        (folded.withColumn("snap", F.lit(int(snap))).write.mode("overwrite")
               .option("partitionOverwriteMode", "dynamic").partitionBy("snap")
               .parquet(self.path(f"{table}__folded")))
        self._retire(table, int(snap))

    def _retire(self, table: str, snap: int) -> None:
        """After snapshot ``snap`` committed: delete the partials folded by the
        previous snapshot and every snapshot before the previous one."""
        snaps = sorted(int(v) for v, _ in _subdirs(self.spark, self.path(f"{table}__folded"), "snap") if v.isdigit())
        older = [k for k in snaps if k < snap]
        if not older:
            return
        prev = older[-1]
        # one row per stream: the highest batch the previous snapshot folded
        bounds = {r.stream_id: r.max_batch_id for r in
                  self.spark.read.parquet(self.path(f"{table}__folded")).where(F.col("snap") == prev)
                      .select("stream_id", "max_batch_id").collect()}
        for stream, stream_path in _subdirs(self.spark, self.path(table), "stream_id"):
            bound = bounds.get(stream)
            if bound is None:
                continue
            for batch, batch_path in _subdirs(self.spark, stream_path, "batch_id"):
                if batch.lstrip("-").isdigit() and int(batch) <= bound:
                    _delete(self.spark, batch_path)
        for k in older[:-1]:
            for suffix in ("__snapshot", "__folded"):
                _delete(self.spark, f"{self.path(table + suffix)}/snap={k}")
