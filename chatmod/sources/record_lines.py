"""Topic records from files of JSON lines, a bounded number of records per micro-batch.

The built-in file source admits whole files; this one admits ``maxRecordsPerTrigger`` records wherever they end, as a
topic does, and goes on inside a file that is still being appended to. Offsets are (file, byte): files are taken in
order of their names, so a new file must sort after those that are there. Planning reads only the lines it admits; the
executors read byte ranges, cut at line ends.

A trigger's admitted end is also written to ``progress`` (a small file; default ``_progress`` in the folder), because a
Python source is not told where a restarted query stood; queries over one folder need different progress files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from chatmod import schema as S
from chatmod.sources.shared_files import files, open_folder
from chatmod.sources.topic import TOPIC_RECORD_SCHEMA

READ_BYTES = 1 << 20
PARTITION_BYTES = 16 << 20          # of one executor's task
START = {"file": "", "byte": 0}


class ByteRange(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        super().__init__({"path": path, "lo": lo, "hi": hi})
        self.path, self.lo, self.hi = path, lo, hi


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("maxRecordsPerTrigger", S.MAX_OFFSETS_PER_TRIGGER))
        self.progress = options.get("progress", f"{self.path}/_progress")
        self.position: dict | None = None

    def initialOffset(self) -> dict:
        return dict(START)

    # the end admitted last, known to a reader that was started anew
    def _recalled(self) -> dict:
        system, path = open_folder(self.progress)
        if system.get_file_info(path).type.name == "NotFound":
            return dict(START)
        with system.open_input_stream(path) as stream:
            return json.loads(stream.read() or json.dumps(START))

    def _remember(self, end: dict) -> None:
        self.position = dict(end)
        system, path = open_folder(self.progress)
        with system.open_output_stream(path + ".new") as stream:
            stream.write(json.dumps(end).encode())
        system.move(path + ".new", path)

    def _ends(self, path: str, lo: int, most: int) -> tuple[int, int]:
        """(byte after the last of at most ``most`` whole lines from ``lo`` on, their number)."""
        system, _ = open_folder(self.path)
        at, end, n = lo, lo, 0
        with system.open_input_file(path) as file:
            file.seek(lo)
            while n < most:
                block = file.read(READ_BYTES)
                if not block:
                    break
                found = block.count(b"\n")
                if n + found <= most:
                    last = block.rfind(b"\n")
                    end = at + last + 1 if last >= 0 else end
                    n += found
                else:
                    place = -1
                    for _ in range(most - n):
                        place = block.index(b"\n", place + 1)
                    end, n = at + place + 1, most
                at += len(block)
        return end, n

    def latestOffset(self) -> dict:
        if self.position is None:
            self.position = self._recalled()
        end, left = dict(self.position), self.limit
        for f in files(self.path):
            if f.base_name < end["file"] or left <= 0:
                continue
            lo = end["byte"] if f.base_name == end["file"] else 0
            if lo >= f.size:
                continue
            hi, n = self._ends(f.path, lo, left)
            if n:
                end, left = {"file": f.base_name, "byte": hi}, left - n
        return end

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        if start == end:
            return out
        for f in files(self.path):
            if f.base_name < start["file"] or f.base_name > end["file"]:
                continue
            lo = start["byte"] if f.base_name == start["file"] else 0
            hi = end["byte"] if f.base_name == end["file"] else self._ends(f.path, lo, 1 << 62)[0]
            while lo < hi:
                cut = hi if hi - lo <= PARTITION_BYTES else self._ends(f.path, lo + PARTITION_BYTES, 1)[0]
                out.append(ByteRange(f.path, lo, min(cut, hi)))
                lo = cut
        self._remember(end)
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        schema = pa.schema([("file", pa.string()), ("line", pa.string())])
        left, rest = partition.hi - partition.lo, b""
        with system.open_input_file(partition.path) as file:
            file.seek(partition.lo)
            while left:
                block = file.read(min(READ_BYTES, left))
                left -= len(block)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                whole = [x.decode("utf-8", "replace") for x in lines if x.strip()]
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(whole)), pa.array(whole, pa.string())], schema=schema)


class RecordLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        return "file string, line string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options)


def read_record_lines(spark: SparkSession, path: str, max_records: int = S.MAX_OFFSETS_PER_TRIGGER, progress: str | None = None) -> DataFrame:
    """Topic records from the JSON lines of the files in ``path``, at most ``max_records`` per micro-batch. Lines that are no
    JSON object give a record of nulls but for the value, the line itself, which ``comment_rejects`` returns."""
    spark.dataSource.register(RecordLines)
    reader = spark.readStream.format("record_lines").option("path", path).option("maxRecordsPerTrigger", str(max_records))
    lines = (reader if progress is None else reader.option("progress", progress)).load()
    parsed = lines.select("line", F.from_json("line", TOPIC_RECORD_SCHEMA).alias("r"))
    broken = F.col("r").isNull() | F.forall(F.array(*[F.col(f"r.{f}").isNull() for f in TOPIC_RECORD_SCHEMA.names]), lambda x: x)
    return parsed.select(*[F.when(broken, F.col("line")).otherwise(F.col("r.value")).alias("value") if f == "value" else F.col(f"r.{f}").alias(f)
                           for f in TOPIC_RECORD_SCHEMA.names])
