"""Score → category, label and moderation action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmod import schema as S


def top_label(df: DataFrame, struct_col: str = "predictions", labels: list[str] | None = None) -> DataFrame:
    """Add ``toxic_score`` (row max, nulls skipped) and ``toxic_category``.

    The scores become one array of (label, score) entries in label order; the
    category is the first entry within the tie tolerance of the array's largest
    score. It is set even when the row is not toxic. All-null predictions give a
    null score and category.
    """
    ranked = F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"{struct_col}.{name}").alias("score"))
                       for name in labels or S.LABELS])
    highest = F.array_max(F.transform(ranked, lambda e: e["score"]))
    leading = F.filter(ranked, lambda e: F.abs(e["score"] - F.col("toxic_score")) < S.LABEL_TIE_TOLERANCE)
    return (df.withColumn("toxic_score", highest)
              .withColumn("toxic_category", F.try_element_at(leading, F.lit(1))["label"]))


def toxic_label(score: Column, threshold: float = S.TOXIC_LABEL_THRESHOLD) -> Column:
    return F.when(score >= threshold, S.LABEL_TOXIC).otherwise(S.LABEL_NOT_TOXIC)


def recommended_action(score: Column, ban: float = S.BAN_THRESHOLD, hide: float = S.HIDE_THRESHOLD,
                       pending: float = S.PENDING_THRESHOLD) -> Column:
    return (F.when(score >= ban, S.ACTION_BAN)
            .when(score >= hide, S.ACTION_HIDE)
            .when(score >= pending, S.ACTION_PENDING)
            .otherwise(S.ACTION_SAFE))


def apply_policy(df: DataFrame, score_col: str = "toxic_score", **thresholds) -> DataFrame:
    """Add ``toxic_label`` and ``recommended_action`` from the score.

    ``thresholds`` may override ``label``, ``ban``, ``hide`` and ``pending``.
    """
    score = F.col(score_col)
    label_t = thresholds.get("label", S.TOXIC_LABEL_THRESHOLD)
    return (df.withColumn("toxic_label", toxic_label(score, label_t))
              .withColumn("recommended_action", recommended_action(
                  score,
                  thresholds.get("ban", S.BAN_THRESHOLD),
                  thresholds.get("hide", S.HIDE_THRESHOLD),
                  thresholds.get("pending", S.PENDING_THRESHOLD))))
