"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmod.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_keys(doc_id: str, text: str) -> list:
    """Two columns that tell input rows apart, whatever the type of the ids. Rows equal in both id and text share them,
    which is harmless wherever equal texts get equal results."""
    d = F.col(doc_id)
    return [F.coalesce(d.try_cast("long"), F.lit(-(1 << 63))).alias("k1"),
            F.xxhash64(d.cast("string"), d.isNull(), F.col(text), F.col(text).isNull()).alias("k2")]
