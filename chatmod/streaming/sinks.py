"""Sinks: keyed topic messages, the bounded crawler status log, leaderboard change events."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmod import schema as S
from chatmod.operators.merge import present
from chatmod.operators.serving import author_totals, top_authors_all
from chatmod.session import bounded_broadcast
from chatmod.streaming.leaderboards import update_boards
from chatmod.streaming.store import PartialStore, _delete, _subdirs


def write_keyed_messages(df: DataFrame, fmt: str = "kafka", path: str | None = None, topic: str = S.TOPIC,
                         options: dict | None = None) -> None:
    """Write ``(key, value)`` rows (``to_keyed_messages``) to a topic or to files."""
    w = df.select("key", "value").write
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if fmt == "kafka":
        w.format("kafka").option("topic", topic).save()
    else:
        w.mode("append").format(fmt).save(path)


class StatusLog:
    """Append-only crawler status events (running / stopped / ended / error), kept to
    the newest ``capacity`` by ``trim``.

    The log lives in generations ``<root>/gen=<n>``; readers use the highest
    generation that committed (``_SUCCESS``). ``trim`` writes the newest events
    as the next generation, so a trim that dies half-way leaves an uncommitted
    folder that nobody reads, and the previous generation stays whole. One
    writer at a time (appends and trims of one log are not concurrent).

    Appends also land in ``<root>/feed``, an append-only folder in blocks of
    ``capacity`` sequence numbers, which ``read_stream`` follows (new events
    only, from where a checkpoint left off). ``trim`` deletes the feed blocks
    that lie wholly before the oldest kept event, so, as with a length-capped
    stream, a reader lagging more than the log's capacity misses trimmed events.
    """

    def __init__(self, spark: SparkSession, root: str, capacity: int = S.STATUS_LOG_CAPACITY):
        self.spark, self.root, self.capacity = spark, root, capacity

    def _generations(self) -> list[int]:
        """Committed generations, ascending (a metadata listing on the driver)."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        gens = []
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            if st.isDirectory() and name.startswith("gen=") and name[4:].isdigit() \
                    and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                gens.append(int(name[4:]))
        return sorted(gens)

    def _path(self, gen: int) -> str:
        return f"{self.root}/gen={gen}"

    def append(self, events: DataFrame) -> None:
        """``events``: type, live_chat_id, video_id, seq (a monotonically increasing id)."""
        gens = self._generations()
        rows = events.select("seq", "type", "live_chat_id", "video_id").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows.write.mode("append").parquet(self._path(gens[-1] if gens else 0))
            (rows.withColumn("block", F.floor(F.col("seq") / self.capacity).cast("long"))
                 .write.mode("append").partitionBy("block").parquet(f"{self.root}/feed"))
        finally:
            rows.unpersist()

    def read_stream(self) -> DataFrame:
        """The status events as an unbounded stream (the push side of the log)."""
        schema = T.StructType(S.STATUS_LOG_SCHEMA.fields + [T.StructField("block", T.LongType(), True)])
        return (self.spark.readStream.schema(schema).parquet(f"{self.root}/feed")
                .select("seq", "type", "live_chat_id", "video_id"))

    def read(self) -> DataFrame:
        gens = self._generations()
        if not gens:
            return self.spark.createDataFrame([], S.STATUS_LOG_SCHEMA)
        return self.spark.read.schema(S.STATUS_LOG_SCHEMA).parquet(self._path(gens[-1]))

    def trim(self) -> DataFrame:
        """Keep the newest ``capacity`` events as the next generation; returns them."""
        gens = self._generations()
        if not gens:
            return self.read()
        keep = self.read().orderBy(F.col("seq").desc()).limit(self.capacity)
        keep.write.mode("overwrite").parquet(self._path(gens[-1] + 1))
        kept = self.read()
        oldest = kept.select(F.min("seq")).first()[0]   # one scalar
        if oldest is not None:
            for block, path in _subdirs(self.spark, f"{self.root}/feed", "block"):
                if block.lstrip("-").isdigit() and (int(block) + 1) * self.capacity <= oldest:
                    _delete(self.spark, path)
        return kept


TOUCHED_AUTHORS_BROADCAST_ROWS = 200_000


def emit_leaderboard_changes(store: PartialStore, batch: DataFrame, stream_id: str, batch_id: int,
                             threshold: float = S.USER_TOXIC_THRESHOLD) -> None:
    """Inside ``foreachBatch``, after the batch's author partials are written: update
    the boards of the videos this batch changed and record those that differ.

    Only the authors with a toxic comment in this batch change; their totals are
    summed from the author partials (semi-joined on those authors), and the new
    board is the top k of the previous board plus them (``update_boards``), so
    the work follows the batch, not the history of its videos."""
    touched = (batch.where((F.col("toxic_score") >= threshold) & present("video_id", "author_id"))
                    .select("video_id", "author_id").distinct())
    touched = bounded_broadcast(touched, TOUCHED_AUTHORS_BROADCAST_ROWS)
    totals = (store.partials("user_metric")
                   .join(touched, on=["video_id", "author_id"], how="left_semi")
                   .groupBy("video_id", "author_id")
                   .agg(F.sum("toxic_count").cast("long").alias("toxic_count")))
    update_boards(totals, batch_id, store, stream_id, table="leaderboard_changes")
