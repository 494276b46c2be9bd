"""Message cleaning: NFC, lower case, strip links / e-mail tokens, collapse spaces."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmod.functions.nfc import compose
from chatmod.schema import GARBAGE_PATTERN, LINK_PATTERN

WHITESPACE = "\t\n\x0b\f\r"     # with the space, the characters of ``schema.WHITESPACE_PATTERN``


def _nfc(value: str) -> str:
    # Most chat text is already composed; is_normalized is much cheaper than normalize.
    return value if unicodedata.is_normalized("NFC", value) else unicodedata.normalize("NFC", value)


def nfc(col: Column) -> Column:
    """NFC in JVM expressions (``functions.nfc``); null becomes the empty string."""
    return compose(F.coalesce(col, F.lit("")))


def strip_garbage(text: Column) -> Column:
    """Remove link / www / e-mail-like tokens. The full pattern only runs on text
    that holds an ``@``; text without one can only match the link alternatives
    (a shorter pattern without the backtracking ``\\S+@``), and text with
    neither ``@``, ``http`` nor ``www.`` is returned as is — same result."""
    has_at = text.contains("@")
    has_link = text.contains("http") | text.contains("www.")
    return (F.when(has_at, F.regexp_replace(text, GARBAGE_PATTERN, ""))
             .when(has_link, F.regexp_replace(text, LINK_PATTERN, ""))
             .otherwise(text))


def single_spaces(df: DataFrame, col: str) -> DataFrame:
    """Each run of white space becomes one space, as by ``schema.WHITESPACE_PATTERN``. Most runs are one character, which
    needs no regular expression; it only runs on text with two spaces side by side. The spaced text has its own projection."""
    spaced = F.col(col)
    for c in WHITESPACE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return df.withColumn(col, spaced).withColumn(
        col, F.when(F.col(col).contains("  "), F.regexp_replace(col, "  +", " ")).otherwise(F.col(col)))


def clean_messages(df: DataFrame, message_col: str = "message", out_col: str = "message_clean",
                   normalize: bool = True) -> DataFrame:
    """Drop rows without a message and add the cleaned text column.

    The normalised, lower-cased text gets its own projection first: the link and
    e-mail checks and the replacement all read it, and inside one conditional
    expression Spark would otherwise recompute it for each use."""
    text = nfc(F.col(message_col)) if normalize else F.coalesce(F.col(message_col), F.lit(""))
    tmp = f"__{out_col}_lower"
    lowered = df.dropna(subset=[message_col]).withColumn(tmp, F.lower(text))
    stripped = lowered.withColumn(tmp, strip_garbage(F.col(tmp)))
    return single_spaces(stripped, tmp).withColumn(out_col, F.trim(tmp)).drop(tmp)
