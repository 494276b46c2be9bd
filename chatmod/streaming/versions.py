"""A store whose tables change together: committed versions, an offset ledger, change feeds, compaction by key range.

``VersionedStore`` keeps the partial tables of ``PartialStore`` with three additions.

**One version over all tables.** A micro-batch writes every table to folders of its own and then publishes one commit
file ``_commits/<version>``, created exclusively, that names the batch and its folders. Readers take their file lists
from the commits, so a batch that is half written, or died so, is in no table; ``at(v)`` reads all tables as of one
version. The writer claims the version after the one whose ledger it read; if another writer got there first the
batch fails and is redone from its checkpoint against the new ledger, so commits are serial.

**Effective once across checkpoints.** A commit includes the runs of offsets the batch counted. A batch that was
committed is skipped, and records whose offsets any stream has committed are left out (``outside_runs``), so a stream
that lost its checkpoint and reads the topic from the start changes nothing.

**Change feeds.** A commit also includes the rows a feed must carry: comments not stored before, and the merged totals
of the windows the batch touched, as inserts or updates. They are read per version, in batch (``changes``) or live
(``chatmod.sources.change_feed``), and do not depend on compaction.

**Compaction by key range.** Snapshot rows lie in ranges of time (a comment keeps its publish time, a metric its
window), one folder per range and generation. A compaction reads and rewrites only the ranges that new rows fall in;
a manifest ``_snapshots/<version>`` names the generation of every range. Folders that a manifest replaced are deleted
one compaction later, so readers that listed them before still find them.

Layout under the root::

    <table>/<stream>/<batch>-<token>/          rows of one batch
    <table>__ranges/gen=<token>/range_id=<n>/  compacted rows of one range
    _commits/<version>, _snapshots/<version>   JSON, published last
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.operators import merge as M
from chatmod.operators import offsets as O
from chatmod.session import bounded_broadcast
from chatmod.streaming.store import SORT_KEYS, TABLES, PartialStore, _delete, _exists, _subdirs

OFFSETS = "offsets"
CHANGES = {"comments": "changes_comments", "stream_metric": "changes_stream_metric"}
VERSIONED = (*TABLES, OFFSETS, *CHANGES.values())
COMPACTED = (*TABLES, OFFSETS)
TIME_COLUMN = {"comments": "published_at", "stream_metric": "window_start", "user_metric": "window_start"}
RANGE_SECONDS = 3600
KEEP_VERSIONS = 10_000          # versions whose change rows stay readable
CLAIM_SECONDS = 30              # an empty commit file is being written, or its writer died
TOUCHED_KEYS_BROADCAST_ROWS = 200_000
NO_RANGE = -(1 << 62)           # rows without a time


class CommitConflict(RuntimeError):
    """Another writer committed after this batch read the ledger; the batch must be redone."""


@dataclass(frozen=True)
class Commit:
    version: int
    stream_id: str
    batch_id: int
    folder: str                 # below <root>/<table>


class _Files:
    """Small files under a folder, through Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.path = lambda name="": self.jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name != "" else folder)
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path()):
            return []
        names = [st.getPath().getName() for st in self.fs.listStatus(self.path())]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict | None:
        """The file's content; None while its writer has not finished."""
        stream = self.fs.open(self.path(f"{number:020d}"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def age(self, number: int) -> float:
        return time.time() - self.fs.getFileStatus(self.path(f"{number:020d}")).getModificationTime() / 1000

    def create(self, number: int, content: dict) -> bool:
        """Publish ``content`` under a number nobody has; False if somebody has."""
        try:
            stream = self.fs.create(self.path(f"{number:020d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(content).encode("utf-8")))
        finally:
            stream.close()
        return True

    def delete(self, number: int) -> None:
        self.fs.delete(self.path(f"{number:020d}"), False)


class VersionedStore(PartialStore):
    def __init__(self, spark: SparkSession, root: str | None = None, user_filter_scope: str = "batch", version: int | None = None,
                 range_seconds: int = RANGE_SECONDS):
        """``version``: read all tables as of this version (default: the newest one at every read)."""
        super().__init__(spark, root, user_filter_scope)
        self.version, self.range_seconds = version, range_seconds
        self._commits = _Files(spark, f"{self.root}/_commits")
        self._manifests = _Files(spark, f"{self.root}/_snapshots")
        self._known: dict[int, Commit] = {}

    # -- versions --------------------------------------------------------------
    def _commit(self, number: int) -> Commit | None:
        if number not in self._known:
            c = self._commits.read(number)
            while c is None and self._commits.age(number) < CLAIM_SECONDS:
                time.sleep(0.05)
                c = self._commits.read(number)
            if c is None:
                return None                     # its writer died; the number stays unused
            self._known[number] = Commit(number, c["stream_id"], c["batch_id"], c["folder"])
        return self._known[number]

    def commits(self, after: int = 0, until: int | None = None) -> list[Commit]:
        """Commits with ``after`` < version <= ``until`` (default: this view's version), oldest first. As many as there are
        batches since the last compaction, or up to ``KEEP_VERSIONS``."""
        until = self.version if until is None else until
        found = (self._commit(n) for n in self._commits.numbers() if n > after and (until is None or n <= until))
        return [c for c in found if c is not None]

    def latest(self) -> int:
        """The newest committed version (0 before the first)."""
        if self.version is not None:
            return self.version
        for n in reversed(self._commits.numbers()):
            if self._commit(n) is not None:
                return n
        return max(self._manifests.numbers(), default=0)

    def at(self, version: int | None = None) -> "VersionedStore":
        """All tables as of one version (default: the newest now), however long the reads take."""
        view = VersionedStore(self.spark, self.root, self.user_filter_scope, self.latest() if version is None else version, self.range_seconds)
        view._known = self._known
        return view

    def _manifest(self, until: int | None = None) -> dict:
        """The newest manifest up to ``until``: version, {table: {range: generation}} and the manifest before it."""
        numbers = self._manifests.numbers()
        for n in reversed(numbers):
            if until is None or n <= until:
                found = self._manifests.read(n)
                if found is not None:
                    return found
        if len(numbers) > 1:                    # the batches that the older one folded are deleted
            raise ValueError(f"version {until} has been folded away; the oldest that can be read is {numbers[0]}")
        return {"version": 0, "tables": {}, "previous": 0}

    # -- reading ---------------------------------------------------------------
    def _folders(self, table: str, commits: list[Commit]) -> list[str]:
        return [f"{self.path(table)}/{c.folder}" for c in commits]

    def _snapshot_rows(self, table: str, manifest: dict, ranges: list[int] | None = None) -> DataFrame | None:
        """Rows of the current generation of every range, or of some ranges."""
        current = {int(r): g for r, g in manifest["tables"].get(table, {}).items() if ranges is None or int(r) in ranges}
        if not current:
            return None
        gens = sorted(set(current.values()))
        rows = self.spark.read.option("basePath", self.path(f"{table}__ranges")).parquet(*[f"{self.path(f'{table}__ranges')}/gen={g}" for g in gens])
        if ranges is not None:
            rows = rows.where(F.col("range_id").isin(ranges))
        # replaced folders that are still there, or folders of other ranges of these generations
        stale: dict[str, list[int]] = {}
        for g in gens:
            for r, _ in _subdirs(self.spark, f"{self.path(f'{table}__ranges')}/gen={g}", "range_id"):
                if current.get(int(r)) != g:
                    stale.setdefault(g, []).append(int(r))
        for g, old in stale.items():
            rows = rows.where(~((F.col("gen") == g) & F.col("range_id").isin(old)))
        return rows.drop("gen", "range_id")

    def partials(self, table: str, raw: DataFrame | None = None, own: str | None = None) -> DataFrame | None:
        """Committed rows: the snapshot's and those of the batches after it (and of the folder ``own``, not yet committed)."""
        if table not in VERSIONED:
            return super().partials(table, raw)
        until = self.latest()
        manifest = self._manifest(until)
        folders = self._folders(table, self.commits(manifest["version"], until)) + ([own] if own else [])
        fresh = self.spark.read.parquet(*folders) if folders else None
        base = self._snapshot_rows(table, manifest)
        if base is None or fresh is None:
            return base if fresh is None else fresh
        return fresh.unionByName(base, allowMissingColumns=True)

    def raw(self, table: str) -> DataFrame | None:
        return self.partials(table) if table in VERSIONED else super().raw(table)

    def changes(self, table: str, since: int = 0, until: int | None = None, video_id: str | None = None) -> DataFrame | None:
        """Feed rows of the versions after ``since``, with their commit_version: for comments those not stored before, for
        stream_metric inserts and updates with the merged totals. None if there are none."""
        kept = self.commits(0, until)
        if kept and since + 1 < kept[0].version:
            raise ValueError(f"changes before version {kept[0].version} have expired; read the tables as of a version and follow them from there")
        kept = [c for c in kept if c.version > since]
        if not kept:
            return None
        rows = self.spark.read.parquet(*self._folders(CHANGES[table], kept))
        versions = self.spark.createDataFrame([(c.stream_id, c.batch_id, c.version) for c in kept], "stream_id string, batch_id long, commit_version long")
        rows = rows.join(F.broadcast(versions), ["stream_id", "batch_id"])         # one small row per version
        return rows if video_id is None else rows.where(F.col("video_id") == video_id)

    def metric_changes(self, since: int = 0, stream_id: str | None = None, video_id: str | None = None) -> DataFrame | None:
        rows = self.changes("stream_metric", since, video_id=video_id)
        return rows if rows is None or stream_id is None else rows.where(F.col("stream_id") == stream_id)

    def comment_inserts(self, since: int = 0, stream_id: str | None = None, video_id: str | None = None) -> DataFrame | None:
        rows = self.changes("comments", since, video_id=video_id)
        return rows if rows is None or stream_id is None else rows.where(F.col("stream_id") == stream_id)

    def ledger(self) -> DataFrame | None:
        """The offsets committed so far, as disjoint runs (partition, lo, hi)."""
        runs = self.partials(OFFSETS)
        return None if runs is None else O.merge_runs(runs.select("partition", "lo", "hi"))

    # -- writing ---------------------------------------------------------------
    def begin(self, stream_id: str, batch_id: int) -> "BatchWriter | None":
        """A writer for one micro-batch; None if that batch was committed already."""
        return None if any(c.stream_id == stream_id and c.batch_id == int(batch_id) for c in self.commits()) else BatchWriter(self, stream_id, batch_id)

    def write(self, df: DataFrame, table: str, stream_id: str, batch_id: int) -> None:
        if table in VERSIONED:
            raise ValueError(f"{table} is written by begin(stream, batch)")
        super().write(df, table, stream_id, batch_id)

    # -- compaction --------------------------------------------------------------
    def _range(self, table: str) -> Column:
        if table not in TIME_COLUMN:
            return F.lit(0).cast("long")
        seconds = F.col(TIME_COLUMN[table]).cast("timestamp").cast("double")
        return F.coalesce(F.floor(seconds / self.range_seconds).cast("long"), F.lit(NO_RANGE))

    @staticmethod
    def _folded(table: str, parts: DataFrame) -> DataFrame:
        """One row per key (and stream) of a table's partial rows."""
        if table == OFFSETS:
            return O.merge_runs(parts.select("partition", "lo", "hi"))
        if table == "comments":
            latest = F.max_by(F.struct(*parts.columns), F.struct("written_at", "batch_id", "stream_id")).alias("r")
            return parts.groupBy("comment_id").agg(latest).select("r.*")
        count = F.coalesce(F.col("version"), F.lit(1)) if "version" in parts.columns else F.lit(1)
        sums = [F.sum(c).cast("long").alias(c) for c in ("total_comments", "toxic_count", "unique_viewers") if c in parts.columns]
        common = [F.max("batch_id").alias("batch_id"), F.max("window_end").alias("window_end"), *sums, F.sum(count).cast("long").alias("version"),
                  F.max("written_at").alias("written_at")]
        if table == "stream_metric":
            sketch = [F.hll_union_agg("unique_viewers_sketch", True).alias("unique_viewers_sketch")] if "unique_viewers_sketch" in parts.columns else []
            return parts.groupBy("stream_id", *M.STREAM_KEY).agg(*common, *sketch)
        last = F.max_by(F.struct("author_name", "author_image"), F.struct("written_at", "batch_id")).alias("last")
        rows = parts.groupBy("stream_id", *M.USER_KEY).agg(*common, last, F.max("last_violation_time").alias("last_violation_time"))
        return rows.select("*", "last.author_name", "last.author_image").drop("last")

    def compact(self, table: str | None = None, snap: int | None = None) -> dict[str, dict[str, int]]:
        """Fold all commits so far into the ranges they touch and publish the manifest of their version. Per table: the
        ranges rewritten, all ranges, and the bytes written. Tables outside the versions are compacted as in ``PartialStore``."""
        if table is not None and table not in VERSIONED:
            super().compact(table, snap)
            return {}
        if self.version is not None:
            raise ValueError("a view of a version is read only")
        until, manifest = self.latest(), self._manifest()
        new = self.commits(manifest["version"], until)
        if not new:
            return {}
        gen, maps, report = f"g{uuid.uuid4().hex}", {}, {}
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for name in COMPACTED:
            fresh = self.spark.read.parquet(*self._folders(name, new))
            touched = sorted(r[0] for r in fresh.select(self._range(name)).distinct().collect())      # ranges of time, not rows
            base = self._snapshot_rows(name, manifest, touched)
            rows = self._folded(name, fresh if base is None else fresh.unionByName(base, allowMissingColumns=True)).withColumn("range_id", self._range(name))
            keys = [k for k in SORT_KEYS.get(name, []) if k in rows.columns]
            # a range is cut into files of neighbouring keys, so one that holds most rows is written by many tasks
            out = f"{self.path(f'{name}__ranges')}/gen={gen}"
            rows.repartitionByRange(parts, "range_id", *keys).sortWithinPartitions("range_id", *keys).write.partitionBy("range_id").parquet(out)
            written = {r for r, _ in _subdirs(self.spark, out, "range_id")}
            old = manifest["tables"].get(name, {})
            maps[name] = {**{r: g for r, g in old.items() if int(r) not in touched}, **{r: gen for r in written}}
            report[name] = {"ranges_rewritten": len(written), "ranges": len(maps[name]), "bytes_written": self._size(out)}
        if not self._manifests.create(until, {"version": until, "tables": maps, "previous": manifest["version"]}):
            raise CommitConflict(f"version {until} was compacted by another writer")
        self._tidy(manifest, until)
        return report

    def _size(self, path: str) -> int:
        files = _Files(self.spark, path)
        return files.fs.getContentSummary(files.path()).getLength()

    def _tidy(self, previous: dict, until: int) -> None:
        """After the manifest of version ``until``: delete the batches that the manifest before it folded, and the range
        folders that one replaced; expire change rows beyond ``KEEP_VERSIONS``."""
        before = self._manifests.read(previous["previous"]) if previous["previous"] in self._manifests.numbers() else None
        for c in self.commits(previous["previous"], previous["version"]):
            for name in COMPACTED:
                _delete(self.spark, f"{self.path(name)}/{c.folder}")
        if before is not None:
            for name, ranges in before["tables"].items():
                for r, g in ranges.items():
                    if previous["tables"].get(name, {}).get(r) != g:
                        _delete(self.spark, f"{self.path(f'{name}__ranges')}/gen={g}/range_id={r}")
            self._manifests.delete(before["version"])
        self.expire(min(previous["version"], until - KEEP_VERSIONS))

    def expire(self, until: int) -> None:
        """Delete the change rows and commit files of versions up to ``until``, which a manifest must have folded."""
        folded = max((n for n in self._manifests.numbers()), default=0)
        for c in self.commits(0, min(until, folded)):
            for name in CHANGES.values():
                _delete(self.spark, f"{self.path(name)}/{c.folder}")
            self._commits.delete(c.version)
            self._known.pop(c.version, None)


class BatchWriter(VersionedStore):
    """One micro-batch on its way into a store: reads see what was committed before it, and its own tables."""

    def __init__(self, store: VersionedStore, stream_id: str, batch_id: int):
        super().__init__(store.spark, store.root, store.user_filter_scope, store.latest(), store.range_seconds)
        self._known = store._known
        self.stream_id, self.batch_id = stream_id, int(batch_id)
        self.next = max(store._commits.numbers() + [self.version]) + 1
        self.folder = f"{re.sub(r'[^A-Za-z0-9_.-]', '_', stream_id)}/{self.batch_id}-{uuid.uuid4().hex}"
        self.written: set[str] = set()

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose offsets no committed batch holds."""
        if not {"offset", "partition"} <= set(batch.columns):
            return batch
        runs = self.ledger()
        return batch if runs is None else O.outside_runs(batch, runs)

    def partials(self, table: str, raw: DataFrame | None = None, own: str | None = None) -> DataFrame | None:
        own = f"{self.path(table)}/{self.folder}" if table in self.written else None
        return super().partials(table, raw, own)

    def write(self, df: DataFrame, table: str, stream_id: str, batch_id: int) -> None:
        if table not in VERSIONED:
            PartialStore.write(self, df, table, stream_id, batch_id)
            return
        keys = [k for k in SORT_KEYS.get(table, []) if k in df.columns]
        if keys:
            df = df.sortWithinPartitions(*keys)
        (df.withColumn("written_at", F.current_timestamp()).withColumn("stream_id", F.lit(self.stream_id))
           .withColumn("batch_id", F.lit(self.batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path(table)}/{self.folder}"))
        self.written.add(table)

    def record(self, batch: DataFrame) -> None:
        """What only a versioned store keeps of a batch, after its tables: the offsets it counted and its change rows."""
        if {"offset", "partition"} <= set(batch.columns):
            runs = O.offset_runs(batch.select(F.col("partition").cast("long").alias("partition"), F.col("offset").cast("long").alias("offset")))
        else:
            runs = self.spark.createDataFrame([], "partition long, lo long, hi long")
        self.write(runs, OFFSETS, self.stream_id, self.batch_id)
        self.write(self._new_comments(), CHANGES["comments"], self.stream_id, self.batch_id)
        self.write(self._changed_windows(), CHANGES["stream_metric"], self.stream_id, self.batch_id)

    def _own(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(table)}/{self.folder}")

    def _before(self, table: str, own: DataFrame) -> DataFrame | None:
        """Committed rows of the time span of this batch's rows (two values, pushed to the scan)."""
        rows = VersionedStore.partials(self, table)
        if rows is None:
            return None
        column = TIME_COLUMN[table]
        micros = F.unix_micros(F.col(column).cast("timestamp"))
        ends = own.select(F.min(micros), F.max(micros)).first()
        lo, hi = (F.timestamp_micros(F.lit(x).cast("long")).cast(rows.schema[column].dataType) for x in ends)
        return rows.where(F.col(column).isNull() if ends[0] is None else F.col(column).between(lo, hi) | F.col(column).isNull())

    def _new_comments(self) -> DataFrame:
        own = self._own("comments").drop("written_at", "stream_id", "batch_id").where(M.present("video_id"))
        first = M.first_delivery(own, "comment_id", [c for c in ("kafka_timestamp", "offset") if c in own.columns])
        stored = self._before("comments", own)      # a comment keeps its publish time
        if stored is not None:
            first = first.join(stored.select("comment_id"), "comment_id", "left_anti")
        return first.select(*[c for c in S.FEED_FIELDS if c in first.columns])

    def _changed_windows(self) -> DataFrame:
        own = self._own("stream_metric").where(M.present("video_id"))
        counts = ["total_comments", "toxic_count", "unique_viewers"]
        merged = own.select(*M.STREAM_KEY, *counts, F.lit(0).alias("old"))
        stored = self._before("stream_metric", own)
        if stored is not None:
            touched = bounded_broadcast(own.select(*M.STREAM_KEY).distinct(), TOUCHED_KEYS_BROADCAST_ROWS)
            merged = merged.unionByName(stored.join(touched, M.STREAM_KEY, "left_semi").select(*M.STREAM_KEY, *counts, F.lit(1).alias("old")))
        return merged.groupBy(*M.STREAM_KEY).agg(F.when(F.max("old") == 1, "update").otherwise("insert").alias("op"),
                                                 *[F.sum(c).cast("long").alias(c) for c in counts])

    def commit(self) -> int:
        """Publish the batch as the next version."""
        missing = set(VERSIONED) - self.written
        if missing:
            raise ValueError(f"not written yet: {sorted(missing)}")
        content = {"stream_id": self.stream_id, "batch_id": self.batch_id, "folder": self.folder, "tables": sorted(self.written)}
        if not self._commits.create(self.next, content):
            raise CommitConflict(f"version {self.next} was committed by another writer")
        return self.next
