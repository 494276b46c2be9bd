"""Decode, rename, flatten, keyed messages, URL ids, timestamps (FIXTURES §5: F1, F10)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from chatmod.functions.urls import extract_video_id
from chatmod.sources.chat_pages import flatten_chat_pages
from chatmod.sources.topic import (camel_to_snake, comment_rejects, decode_comments, parse_published_at,
                                   snake_case_columns, to_keyed_messages)

TS = dt.datetime(2024, 1, 1, 0, 0, 0)


def _records(spark, values):
    rows = [("v1", v, "comment", 0, i, TS) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long, "
                                       "timestamp timestamp")


def test_decode_f1(spark):
    good = {"commentId": "c1", "videoId": "v1", "message": "hi", "authorId": "a", "authorImage": "",
            "authorName": "n", "publishedAt": "2024-01-01T00:00:00Z"}
    values = [json.dumps(good), json.dumps({**good, "commentId": "c2", "extra": 1}), "junk",
              json.dumps({**good, "commentId": "c3", "message": 5}), json.dumps({k: v for k, v in good.items() if k != "commentId"})]
    rec = _records(spark, values)
    out = decode_comments(rec).orderBy("comment_id").collect()
    assert [r.comment_id for r in out] == ["c1", "c2", "c3"]
    assert out[2].message == "5"
    assert set(decode_comments(rec).columns) >= {"comment_id", "video_id", "author_image", "published_at",
                                                  "kafka_timestamp", "offset", "partition"}
    assert comment_rejects(rec).count() == 2


def test_snake_case():
    assert camel_to_snake("commentId") == "comment_id"
    assert camel_to_snake("authorImage") == "author_image"
    assert camel_to_snake("HTTPCode") == "http_code"
    assert camel_to_snake("video_id") == "video_id"


def test_snake_case_columns(spark):
    df = spark.createDataFrame([(1, 2)], "videoId int, publishedAt int")
    assert snake_case_columns(df).columns == ["video_id", "published_at"]


def test_bad_timestamp_f10(spark):
    df = spark.createDataFrame([("bad",), ("2024-01-01T00:00:07.5",)], "published_at string")
    out = [r.published_at for r in parse_published_at(df, zone_free=True).collect()]
    assert out == [None, dt.datetime(2024, 1, 1, 0, 0, 7, 500000)]


def test_keyed_messages_roundtrip(spark):
    df = spark.createDataFrame([("c1", "v1", "hi")], "commentId string, videoId string, message string")
    row = to_keyed_messages(df).collect()[0]
    assert row.key == "v1" and json.loads(row.value) == {"type": "CHAT", "commentId": "c1", "videoId": "v1", "message": "hi"}


def test_flatten_chat_pages(spark):
    page = {"video_id": "vid", "items": [
        {"id": "m1", "snippet": {"type": "textMessageEvent", "authorChannelId": "a1", "publishedAt": "t1",
                                 "textMessageDetails": {"messageText": "hello"}},
         "authorDetails": {"displayName": "Ann", "profileImageUrl": "img"}},
        {"id": "m2", "snippet": {"type": "superChatEvent", "authorChannelId": "a2", "publishedAt": "t2"},
         "authorDetails": {"displayName": "Bob", "profileImageUrl": ""}},
    ]}
    from chatmod.schema import CHAT_PAGE_SCHEMA
    pages = spark.read.schema(CHAT_PAGE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(page)]))
    out = flatten_chat_pages(pages).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.type, r.commentId, r.videoId, r.message, r.authorId, r.authorName, r.authorImage, r.publishedAt) == \
        ("CHAT", "m1", "vid", "hello", "a1", "Ann", "img", "t1")


def test_video_id_forms(spark):
    urls = ["https://www.youtube.com/watch?v=dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?t=3",
            "https://www.youtube.com/shorts/dQw4w9WgXcQ", "https://www.youtube.com/embed/dQw4w9WgXcQ",
            "https://www.youtube.com/watch?app=d&v=dQw4w9WgXcQ", "https://example.com/watch?v=short"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    server = [r.video_id for r in extract_video_id(df, form="server").collect()]
    client = [r.video_id for r in extract_video_id(df, form="client").collect()]
    assert server == ["dQw4w9WgXcQ"] * 5 + [None]
    # the browser rule knows no shorts/ links and stops at the first parameter
    assert client[2] is None and client[4] is None and client[0] == "dQw4w9WgXcQ"
    hosts = [r.is_video_host for r in extract_video_id(df).collect()]
    assert hosts == [True] * 5 + [False]


def test_video_id_rejects(spark):
    from chatmod.functions.urls import video_id_rejects

    urls = ["https://youtu.be/dQw4w9WgXcQ", "https://www.youtube.com/watch?v=tooShort", "not a url", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    assert sorted(r.i for r in video_id_rejects(extract_video_id(df)).collect()) == [1, 2, 3]


def test_kafka_reader_options(spark, monkeypatch):
    """The connector jar is not on this classpath: check the reader configuration only."""
    from pyspark.sql import SparkSession

    from chatmod.sources.topic import read_comment_stream

    class Recorder:
        def __init__(self):
            self.opts = {}

        def format(self, f):
            self.opts["format"] = f
            return self

        def option(self, k, v):
            self.opts[k] = v
            return self

        def load(self, *a):
            return self.opts

    monkeypatch.setattr(SparkSession, "readStream", property(lambda self: Recorder()))
    opts = read_comment_stream(spark, "kafka", options={"kafka.bootstrap.servers": "b:9092", "minPartitions": 12})
    assert opts == {"format": "kafka", "subscribe": "comment", "maxOffsetsPerTrigger": "100",
                    "startingOffsets": "earliest", "failOnDataLoss": "false", "minPartitions": "12",
                    "kafka.bootstrap.servers": "b:9092"}
    assert read_comment_stream(spark, "kafka")["minPartitions"] == str(spark.sparkContext.defaultParallelism)


def test_processing_time_stamp_p5(spark):
    good = {"commentId": "c1", "videoId": "v1", "message": "hi", "authorId": "a", "authorImage": "",
            "authorName": "n", "publishedAt": "2024-01-01T00:00:00Z"}
    out = decode_comments(_records(spark, [json.dumps(good)]), stamp_processing_time=True)
    assert dict(out.dtypes)["processing_time"] == "timestamp"
    row = out.collect()[0]
    assert row.processing_time is not None and row.comment_id == "c1"
    assert "processing_time" not in decode_comments(_records(spark, [json.dumps(good)])).columns
