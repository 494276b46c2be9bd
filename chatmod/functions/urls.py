"""Video id extraction from watch / short / embed URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmod import schema as S


def _valid(candidate: Column) -> Column:
    return F.when(F.length(candidate) == S.VIDEO_ID_LENGTH, candidate)


def is_video_host(url: Column) -> Column:
    cond = None
    for host in S.VIDEO_HOSTS:
        c = url.contains(host)
        cond = c if cond is None else (cond | c)
    return cond


def extract_video_id(df: DataFrame, url_col: str = "url", form: str = "server") -> DataFrame:
    """Add ``video_id`` (null when the URL holds no 11-character id) and ``is_video_host``.

    Rows with a null id are the rejects; ``video_id_rejects`` selects them.
    """
    pattern, group = ((S.VIDEO_ID_PATTERN_SERVER, 1) if form == "server" else (S.VIDEO_ID_PATTERN_CLIENT, 7))
    url = F.col(url_col)
    # the regex runs once per row: its result gets its own projection before the
    # length check reads it twice
    cand = "__video_id_candidate"
    return (df.withColumn(cand, F.regexp_extract(url, pattern, group))
              .withColumn("video_id", _valid(F.col(cand)))
              .withColumn("is_video_host", is_video_host(url))
              .drop(cand))


def video_id_rejects(extracted: DataFrame) -> DataFrame:
    """Rows of ``extract_video_id`` output whose URL holds no valid id (the server
    answers these with an error instead of starting a crawl)."""
    return extracted.where(F.col("video_id").isNull())
