"""Run the whole moderation pipeline: ``python -m chatmod [options]``.

Starts three queries over one comment topic and waits for them:

* ``comments`` — decode, clean, score, policy; per micro-batch the comment,
  channel-metric and author-metric partials (``start_stream``);
* ``leaderboards`` — running toxic counts in the state store, boards written
  when they change (``start_leaderboard_stream``);
* ``rejects`` — records that do not decode to a comment.

Everything is written under the shared folder the cluster names in
``spark.checkpoint.dir`` (or ``--store``), checkpoints included, so a restart
resumes where each query stopped.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from chatmod import schema as S
from chatmod.session import build_session
from chatmod.sources.topic import decode_comments, read_comment_stream
from chatmod.streaming.job import start_rejects_stream, start_stream, transform_comments
from chatmod.streaming.leaderboards import start_leaderboard_stream
from chatmod.streaming.store import PartialStore


def start_all(spark: SparkSession, source: str = "kafka", path: str | None = None, options: dict | None = None,
              store: PartialStore | None = None, trigger: dict | None = None) -> list[StreamingQuery]:
    """Start the comment, leaderboard and rejects queries; each reads the topic itself
    (a Kafka topic serves any number of readers) and keeps its own checkpoint."""
    store = store or PartialStore(spark)

    def records():
        return read_comment_stream(spark, source, path, dict(options or {}))

    board_input = records()
    if source != "kafka":
        # the stateful aggregate keeps the scoring in the streaming plan, where a
        # one-file trigger is one task; Kafka reads split by minPartitions instead
        board_input = board_input.repartition(spark.sparkContext.defaultParallelism)
    scored = transform_comments(decode_comments(board_input, stamp_processing_time=True))
    return [
        start_stream(spark, records(), store, trigger=trigger, query_name="comments"),
        start_leaderboard_stream(spark, scored, store, trigger=trigger, query_name="leaderboards"),
        start_rejects_stream(spark, records(), store, trigger=trigger),
    ]


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m chatmod", description=__doc__.splitlines()[0])
    p.add_argument("--source", choices=["kafka", "json", "parquet"], default="kafka")
    p.add_argument("--path", help="folder of topic-record files (file sources)")
    p.add_argument("--bootstrap-servers", help="kafka.bootstrap.servers (Kafka source)")
    p.add_argument("--option", action="append", default=[], metavar="KEY=VALUE",
                   help="source option, repeatable (e.g. maxOffsetsPerTrigger=100000, minPartitions=64)")
    p.add_argument("--store", help="root of the tables (default: under spark.checkpoint.dir)")
    p.add_argument("--trigger", default=S.TRIGGER_INTERVAL, help="processing-time trigger, e.g. '10 seconds'")
    p.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[StreamingQuery]:
    args = parse_args(argv)
    spark = spark or build_session(app_name="chatmod")
    options = dict(o.split("=", 1) for o in args.option)
    if args.bootstrap_servers:
        options["kafka.bootstrap.servers"] = args.bootstrap_servers
    store = PartialStore(spark, args.store) if args.store else None
    trigger = {"availableNow": True} if args.available_now else {"processingTime": args.trigger}
    queries = start_all(spark, args.source, args.path, options, store, trigger)
    for q in queries:
        q.awaitTermination()
    return queries
