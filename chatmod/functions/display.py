"""Small display expressions used by the feed view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def author_initials(name: Column, image: Column) -> Column:
    """First two characters of the name, upper case, when there is no avatar image."""
    return F.when(F.coalesce(image, F.lit("")) == "", F.upper(F.substring(name, 1, 2)))


def time_label(ts: Column) -> Column:
    """``HH:mm`` of a timestamp."""
    return F.date_format(ts, "HH:mm")


def null_to_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))
