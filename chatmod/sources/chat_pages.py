"""Raw chat API pages → comment payload rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmod import schema as S


def read_chat_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON pages (``video_id`` + ``items``) with the declared schema; no inference."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(S.CHAT_PAGE_SCHEMA).json(path)


def flatten_chat_pages(pages: DataFrame) -> DataFrame:
    """One payload row per text-message item (camelCase payload fields).

    ``explode`` runs inside each page's task, so pages never meet in a shuffle.
    """
    items = pages.select(F.col("video_id"), F.explode("items").alias("item"))
    return (items
            .where(F.col("item.snippet.type") == S.TEXT_MESSAGE_EVENT)
            .select(
                F.lit(S.MESSAGE_TYPE_CHAT).alias("type"),
                F.col("item.id").alias("commentId"),
                F.col("video_id").alias("videoId"),
                F.col("item.snippet.textMessageDetails.messageText").alias("message"),
                F.col("item.snippet.authorChannelId").alias("authorId"),
                F.col("item.authorDetails.profileImageUrl").alias("authorImage"),
                F.col("item.authorDetails.displayName").alias("authorName"),
                F.col("item.snippet.publishedAt").alias("publishedAt"),
            ))
