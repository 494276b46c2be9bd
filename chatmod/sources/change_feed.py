"""The live change feed: a streaming reader of a ``VersionedStore``'s committed versions.

A Python data source whose offsets are versions. Planning lists the commits after the last one read; every commit's
change rows are one or more partitions, read by the executors as Arrow batches. A version is published only when all
its rows are written, and change rows are untouched by compaction, so a reader sees every version once and whole.

    read_changes(spark, store.root, "stream_metric").writeStream...

Options: ``path`` (the store's root), ``table`` (comments or stream_metric), ``since`` (the version to start after; default
0, all that is kept), ``video`` (only this video's rows).
"""

from __future__ import annotations

import json
import time

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from chatmod import schema as S
from chatmod.sources.shared_files import files, open_folder

META = "stream_id string, batch_id long, commit_version long"
SCHEMAS = {
    "comments": ", ".join(f"{c} {'timestamp' if c == 'published_at' else 'string'}" for c in S.FEED_FIELDS) + ", " + META,
    "stream_metric": f"video_id string, window_start timestamp, op string, total_comments long, toxic_count long, unique_viewers long, {META}",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
CLAIM_SECONDS = 30          # an empty commit file is being written, or its writer died


class VersionFile(InputPartition):
    def __init__(self, path: str, version: int):
        super().__init__({"path": path, "version": version})
        self.path, self.version = path, version


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.table = options["path"].rstrip("/"), options.get("table", "stream_metric")
        self.since, self.video = int(options.get("since", 0)), options.get("video")
        self.fields = [(f.split()[0], _ARROW[f.split()[1]]) for f in SCHEMAS[self.table].split(", ")]

    def _commits(self, after: int, until: int | None = None) -> list[tuple[int, str]]:
        """(version, folder) of the commits after ``after``. A version that is still being published hides those after it."""
        system, _ = open_folder(self.root)
        out = []
        for f in files(f"{self.root}/_commits"):
            version = int(f.base_name)
            if version <= after or (until is not None and version > until):
                continue
            with system.open_input_stream(f.path) as stream:
                text = stream.read()
            try:
                out.append((version, json.loads(text)["folder"]))
            except ValueError:
                if time.time() - f.mtime.timestamp() < CLAIM_SECONDS:
                    break
        return out

    def initialOffset(self) -> dict:
        return {"version": self.since}

    def latestOffset(self) -> dict:
        commits = self._commits(getattr(self, "seen", self.since))
        self.seen = commits[-1][0] if commits else getattr(self, "seen", self.since)
        return {"version": self.seen}

    def partitions(self, start: dict, end: dict) -> list[VersionFile]:
        self.seen = max(getattr(self, "seen", 0), end["version"])
        found = self._commits(start["version"], end["version"])
        kept = [int(f.base_name) for f in files(f"{self.root}/_commits")]
        if kept and start["version"] and start["version"] + 1 < kept[0]:
            raise ValueError(f"changes before version {kept[0]} have expired; read the tables as of a version and follow them from there")
        return [VersionFile(f.path, version) for version, folder in found
                for f in files(f"{self.root}/changes_{self.table}/{folder}") if f.base_name.endswith(".parquet")]

    def read(self, partition: VersionFile):
        system, _ = open_folder(self.root)
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=4096):
                table = pa.Table.from_batches([batch])
                if self.video is not None:
                    table = table.filter(pc.equal(table.column("video_id"), self.video))
                columns = []
                for name, kind in self.fields:
                    if name == "commit_version":
                        columns.append(pa.array([partition.version] * table.num_rows, pa.int64()))
                    elif name not in table.column_names:
                        columns.append(pa.nulls(table.num_rows, kind))
                    else:
                        column = table.column(name).combine_chunks()
                        if pa.types.is_timestamp(kind) and column.type.tz is None:
                            column = column.cast(pa.timestamp("us"))
                        columns.append(column.cast(kind))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(self.fields))


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_changes"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "stream_metric")]

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def read_changes(spark: SparkSession, root: str, table: str = "stream_metric", since: int = 0, video_id: str | None = None) -> DataFrame:
    """The changes committed to the store at ``root`` after version ``since``, as an unbounded stream."""
    spark.dataSource.register(ChangeFeed)
    reader = spark.readStream.format("chat_changes").option("path", root).option("table", table).option("since", str(since))
    return (reader if video_id is None else reader.option("video", video_id)).load()
