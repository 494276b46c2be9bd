"""Schemas, label names, thresholds and patterns shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Label order matters: the category is the first label (in this order) whose
# score is within LABEL_TIE_TOLERANCE of the row maximum.
LABELS = ["toxic", "severe_toxic", "threat", "insult", "identity_hate"]
LABEL_TIE_TOLERANCE = 1e-6

# Decision thresholds (inclusive unless stated).
TOXIC_LABEL_THRESHOLD = 0.7        # toxic_label = "Toxic" when score >= 0.7
BAN_THRESHOLD = 0.9                # action "Ban"     when score >= 0.9
HIDE_THRESHOLD = 0.7               # action "Hide"    when score >= 0.7
PENDING_THRESHOLD = 0.5            # action "Pending" when score >= 0.5
STREAM_TOXIC_THRESHOLD = 0.7       # stream metrics count score >  0.7 (strict)
USER_TOXIC_THRESHOLD = 0.7         # user metrics count score   >= 0.7 (inclusive)

LABEL_TOXIC = "Toxic"
LABEL_NOT_TOXIC = "Not Toxic"
ACTION_BAN = "Ban"
ACTION_HIDE = "Hide"
ACTION_PENDING = "Pending"
ACTION_SAFE = "Safe"

SCORE_DECIMALS = 3                 # scores and ratios are rounded to 3 places
MODEL_MAX_TOKENS = 128             # scorer input truncation length (tokens)
APPROX_DISTINCT_RSD = 0.01         # relative std. dev. of approximate distinct counts

# Text cleaning: URL / www / e-mail-like tokens are removed, whitespace collapsed.
# (an e-mail-like token is looked for once, from its start: every alternative runs to the token's end)
GARBAGE_PATTERN = r"(https?://\S+|www\.\S+|(?<!\S)\S+@\S+)"
LINK_PATTERN = r"(https?://\S+|www\.\S+)"   # the same without the e-mail alternative
WHITESPACE_PATTERN = r"\s+"

# Chat-page event type that carries a text message, and the payload type tag.
TEXT_MESSAGE_EVENT = "textMessageEvent"
MESSAGE_TYPE_CHAT = "CHAT"

# Video id extraction. Server form: group 1; client form: group 7. Valid ids
# have exactly 11 characters.
VIDEO_ID_PATTERN_SERVER = (
    r"^.*(?:(?:youtu\.be\/|v\/|vi\/|u\/\w\/|embed\/|shorts\/)|(?:(?:watch)?\?v(?:i)?=|\&v(?:i)?=))([^#\&\?]*).*"
)
VIDEO_ID_PATTERN_CLIENT = r"^.*((youtu.be\/)|(v\/)|(\/u\/\w\/)|(embed\/)|(watch\?))\??v?=?([^#&?]*).*"
VIDEO_ID_LENGTH = 11
VIDEO_HOSTS = ["youtube.com", "youtu.be"]

# Serving sizes.
LATEST_COMMENTS_LIMIT = 100        # comments in a snapshot / rolling feed
RECENT_WINDOWS_LIMIT = 20          # chart points
LEADERBOARD_SIZE = 5               # top toxic authors
STATUS_LOOKBACK = 100              # newest status events searched per snapshot
STATUS_LOG_CAPACITY = 1000         # status events kept by the bounded log

# Enrichment defaults for authors missing from the lookup.
UNKNOWN_AUTHOR_NAME = "Unknown"
UNKNOWN_AUTHOR_IMAGE = ""

# Crawler status values.
STATUS_TYPES = ["running", "stopped", "ended", "error"]

# Stream source defaults.
TOPIC = "comment"
MAX_OFFSETS_PER_TRIGGER = 100
TRIGGER_INTERVAL = "10 seconds"
METRIC_WINDOW = "1 minute"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

# JSON payload on the topic; `type` is carried by producers but ignored on decode.
PAYLOAD_FIELDS = ["commentId", "videoId", "message", "authorId", "authorImage", "authorName", "publishedAt"]
PAYLOAD_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in PAYLOAD_FIELDS])
PRODUCER_PAYLOAD_SCHEMA = T.StructType(
    [T.StructField("type", T.StringType(), True)] + list(PAYLOAD_SCHEMA.fields)
)

PREDICTIONS_SCHEMA = T.StructType([T.StructField(l, T.DoubleType(), True) for l in LABELS])

CHAT_ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("snippet", T.StructType([
        T.StructField("type", T.StringType(), True),
        T.StructField("authorChannelId", T.StringType(), True),
        T.StructField("publishedAt", T.StringType(), True),
        T.StructField("textMessageDetails", T.StructType([
            T.StructField("messageText", T.StringType(), True),
        ]), True),
    ]), True),
    T.StructField("authorDetails", T.StructType([
        T.StructField("displayName", T.StringType(), True),
        T.StructField("profileImageUrl", T.StringType(), True),
    ]), True),
])
CHAT_PAGE_SCHEMA = T.StructType([
    T.StructField("video_id", T.StringType(), True),
    T.StructField("items", T.ArrayType(CHAT_ITEM_SCHEMA), True),
])

STATUS_LOG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("live_chat_id", T.StringType(), True),
    T.StructField("video_id", T.StringType(), True),
])

# Columns of the served comment snapshot (latest comments).
SERVED_COMMENT_FIELDS = [
    "comment_id", "author_name", "message", "toxic_label", "toxic_category",
    "recommended_action", "published_at",
]
# Columns of a pushed feed row.
FEED_FIELDS = [
    "comment_id", "video_id", "author_id", "author_name", "author_image", "message",
    "published_at", "toxic_label", "toxic_category", "recommended_action",
]
