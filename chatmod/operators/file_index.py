"""Look-ups that open few files: rows in an order that fills (video, time), and a small index over the files.

``write_indexed`` sorts rows along a space-filling curve (the bits of a hash of the video and of the time, in turn), so
that every file covers a small rectangle of videos and times, and writes one index row per file (its rectangle) and a
Bloom filter of the ids in it (``bitmap_construct_agg``, 4 KB rows). A look-up asks the index which files can hold its
rows and reads only those: a span of one video by the rectangles, ids by the Bloom filters. What the files give is
filtered again, so the answers are exact.

The rows are cut into files by range of (curve, id): a video of a third of all rows, or many rows of one instant, are
many files. Null ids, videos or times are kept; look-ups never find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmod.session import bounded_broadcast

CURVE_BITS = 16             # of each of video and time
BITMAP = 1 << 15            # bits of one row of a Bloom filter (Spark's bitmap aggregates)
BITS_PER_ROW = 12
HASHES = 5
ROWS_PER_FILE = 1_000_000
ASKED_IDS = 100_000         # ids of one look-up broadcast to the files up to this many


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _video_hash(video: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(video), 64 - CURVE_BITS)


def _interleaved(x: Column, y: Column) -> Column:
    out = F.lit(0).cast("long")
    for b in range(CURVE_BITS):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), 2 * b + 1)).bitwiseOR(
            F.shiftleft(F.shiftright(y, b).bitwiseAND(F.lit(1)), 2 * b))
    return out


def _places(ident: Column, bits: Column) -> Column:
    """The bits of an id in a Bloom filter of ``bits`` bits, by double hashing."""
    text = ident.cast("string")
    first, step = F.pmod(F.xxhash64(text), bits), F.pmod(F.xxhash64(F.lit(1), text), bits).bitwiseOR(F.lit(1))
    return F.array_distinct(F.array(*[F.pmod(first + step * i, bits) for i in range(HASHES)]))


def _has(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1


def write_indexed(rows: DataFrame, path: str, id_col: str = "comment_id", video_col: str = "video_id", time_col: str = "published_at",
                  rows_per_file: int = ROWS_PER_FILE) -> None:
    """``rows`` as ``<path>/rows``, and ``<path>/files`` and ``<path>/blooms`` about them."""
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(_micros(time_col)), F.max(_micros(time_col))).first()
    files = max(1, -(-n // rows_per_file))
    lo, width = lo or 0, max(1, (hi or 0) - (lo or 0))
    when = F.coalesce(((_micros(time_col) - lo) / F.lit(float(width)) * ((1 << CURVE_BITS) - 1)).cast("long"), F.lit(0))
    curve = rows.withColumn("__curve", _interleaved(_video_hash(F.col(video_col)), when))
    curve.repartitionByRange(files, "__curve", id_col).sortWithinPartitions(video_col, time_col).drop("__curve").write.parquet(f"{path}/rows")
    spark = rows.sparkSession
    written = spark.read.parquet(f"{path}/rows").select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("file"), F.col(id_col).alias("id"),
        _video_hash(F.col(video_col)).alias("video"), F.col(video_col).isNotNull().alias("known"), _micros(time_col).alias("at"))
    span = written.groupBy("file").agg(F.min("video").alias("min_video"), F.max("video").alias("max_video"), F.min("at").alias("min_at"),
                                       F.max("at").alias("max_at"), F.count(F.lit(1)).alias("rows"))
    span.withColumn("bits", F.ceil(F.col("rows") * BITS_PER_ROW / BITMAP).cast("long") * BITMAP).write.parquet(f"{path}/files")
    sizes = spark.read.parquet(f"{path}/files").select("file", "bits")
    # one row per file: as many as the table has files
    bits = written.where("id is not null").join(bounded_broadcast(sizes, ASKED_IDS), "file").select("file", F.explode(_places(F.col("id"), F.col("bits"))).alias("at"))
    (bits.groupBy("file", F.floor(F.col("at") / BITMAP).cast("long").alias("block")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BITMAP))).alias("bitmap"))
         .repartitionByRange("file").write.parquet(f"{path}/blooms"))


def files_of_span(spark: SparkSession, path: str, video_id: str, start, end) -> list[str]:
    """Names of the files whose rectangle holds (video, any time from ``start`` to ``end``)."""
    video, lo, hi = (spark.range(1).select(_video_hash(F.lit(video_id)).alias("v"), F.unix_micros(F.lit(start).cast("timestamp")).alias("lo"),
                                           F.unix_micros(F.lit(end).cast("timestamp")).alias("hi")).first())
    spans = spark.read.parquet(f"{path}/files").where((F.col("min_video") <= video) & (F.col("max_video") >= video) & (F.col("min_at") <= hi) & (F.col("max_at") >= lo))
    return sorted(r.file for r in spans.select("file").collect())


def files_of_ids(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "comment_id") -> list[str]:
    """Names of the files whose Bloom filter may hold one of ``ids``."""
    sizes = spark.read.parquet(f"{path}/files").select("file", "bits")
    asked = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    # filters come in few sizes; an id has its bits once per size, not per file
    kinds = [r.bits for r in sizes.select("bits").distinct().collect()]
    places = asked.select("id", F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("bits"), _places(F.col("id"), F.lit(b).cast("long")).alias("at")) for b in kinds])).alias("p"))
    places = places.select("id", "p.bits", F.size("p.at").alias("n"), F.explode("p.at").alias("at"))
    places = places.select("id", "bits", "n", F.floor(F.col("at") / BITMAP).cast("long").alias("block"), F.pmod("at", F.lit(BITMAP)).cast("int").alias("place"))
    blooms = spark.read.parquet(f"{path}/blooms").join(bounded_broadcast(sizes, ASKED_IDS), "file")
    hits = blooms.join(bounded_broadcast(places, ASKED_IDS * HASHES), ["bits", "block"]).where(_has(F.col("bitmap"), F.col("place")))
    found = hits.groupBy("file", "id", "n").agg(F.count(F.lit(1)).alias("set")).where("set = n")
    return sorted(r.file for r in found.select("file").distinct().collect())


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    rows = spark.read.schema(spark.read.parquet(f"{path}/rows").schema)
    return rows.parquet(*[f"{path}/rows/{f}" for f in files]) if files else spark.createDataFrame([], spark.read.parquet(f"{path}/rows").schema)


def find_span(spark: SparkSession, path: str, video_id: str, start, end, video_col: str = "video_id", time_col: str = "published_at") -> DataFrame:
    """The rows of a video from ``start`` to ``end`` (both included)."""
    rows = _read(spark, path, files_of_span(spark, path, video_id, start, end))
    kind = rows.schema[time_col].dataType
    return rows.where((F.col(video_col) == video_id) & F.col(time_col).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def find_ids(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "comment_id") -> DataFrame:
    """The rows whose id is among ``ids``."""
    rows = _read(spark, path, files_of_ids(spark, path, ids, id_col))
    return rows.join(bounded_broadcast(ids.select(id_col).distinct(), ASKED_IDS), id_col, "left_semi")
