"""Session helpers: builder defaults, shared storage locations, guarded broadcast."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Batch settings that matter at scale. AQE coalesces small shuffle partitions
# and splits skewed joins; the initial partition count is sized from the
# cluster's cores in ``build_session`` unless configured.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stopTimeout": "15s",
    "spark.python.worker.reuse": "true",
    "spark.ui.enabled": "false",
    # checkpoint files (e.g. leaderboard deltas) are removed once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


SHUFFLE_PARTITION_KEYS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
PARTITIONS_PER_CORE = 4


def build_session(master: str | None = None, app_name: str = "chatmod", conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults applied.

    When neither the caller nor the cluster configuration sets a shuffle
    partition count, AQE starts every shuffle at ``PARTITIONS_PER_CORE`` × the
    cluster's cores (at least Spark's 200) and coalesces small ones to the
    advisory size: AQE can merge partitions but never add them, so a fixed 200
    would leave each reducer of a large shuffle with far more than fits in memory.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**DEFAULT_CONF, **(conf or {})}
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    launch = spark.sparkContext.getConf()
    if not any(k in conf or launch.contains(k) for k in SHUFFLE_PARTITION_KEYS):
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set(SHUFFLE_PARTITION_KEYS[1], str(max(200, PARTITIONS_PER_CORE * cores)))
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A location under the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) is a folder chosen here, and then it is set on the session so
    every later caller agrees.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="chatmod-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, *parts) if parts else base


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it really has at most ``max_rows`` rows.

    The count runs on a ``limit(max_rows + 1)`` so it stops early on a large
    side; beyond the bound the DataFrame is returned unchanged and the join
    falls back to a shuffle join (which AQE may still convert at run time).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


# Inputs up to this size may be dealt over the cores when they arrive as fewer files than
# cores (a shuffle of at most this much is cheap next to whole-text work); larger inputs
# are only reshuffled for callers that ask for it (``any_size``).
SPREAD_MAX_BYTES = 512 * 1024 * 1024


SPREAD_BYTES_PER_TASK = 1024 * 1024   # at least this much input per spread partition
SPREAD_MAX_BYTES_PER_TASK = 16 * 1024 * 1024   # and at most this much, however few the cores


def _small_input_bytes(df: DataFrame, cores: int, any_size: bool) -> int | None:
    """Total input bytes when ``df`` reads fewer files than cores, totalling at
    most ``SPREAD_MAX_BYTES`` unless ``any_size``; None otherwise.

    A Parquet row group is never split, so one file with one row group is
    read by one task whatever the split count says. Only file lengths are looked
    up (metadata), and only for fewer files than cores."""
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return None
    sc = df.sparkSession.sparkContext
    conf, fs_path = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    total = 0
    for f in files:
        p = fs_path(f)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
        if total > SPREAD_MAX_BYTES and not any_size:
            return None
    return total


def spread_for_cpu(df: DataFrame, any_size: bool = False) -> DataFrame:
    """Deal a scan-level ``df`` over the cores when its input cannot use them:
    fewer files than cores totalling at most ``SPREAD_MAX_BYTES`` (a row group
    is never split, so one file is read by one or a few tasks). The CPU-heavy
    per-row work that follows (whole-text JSON, regex) then runs on up to every
    core, with ``SPREAD_BYTES_PER_TASK`` to ``SPREAD_MAX_BYTES_PER_TASK`` of input
    per task: a wide cluster does not get thousands of near-empty tasks, and on a
    narrow one a task's time and memory stay the same as the input grows.

    ``any_size`` is for work whose longest task or largest sort would grow with
    the row groups of a few large files: there is no limit on their size then, and
    rows are dealt by the hash of the whole row, which sorts nothing.

    Decided from the input files alone — nothing is planned or run (asking a
    DataFrame with shuffles for its partition count would run the shuffles).
    Inputs of many files, or above the limit, are returned unchanged. Meant for
    frames read straight from files: after a shuffle the rows are already spread.
    Round-robin repartitioning sorts rows first, so a retried task gets the same
    rows; those dealt by hash it gets anyway.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        total = _small_input_bytes(df, cores, any_size)
    except Exception:  # noqa: BLE001 - e.g. no JVM access (Spark Connect): leave as is
        return df
    if total is None:
        return df
    parts = max(min(cores, -(-total // SPREAD_BYTES_PER_TASK)), -(-total // SPREAD_MAX_BYTES_PER_TASK))
    if parts <= 1:
        return df
    return df.repartition(parts, *df.columns) if any_size else df.repartition(parts)
