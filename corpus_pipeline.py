"""A training corpus from raw documents, in stages that each write a table and read it again.

Every stage works on what the stage before kept: toxic documents go, one document of each group of equal and of
near-equal texts stays, documents that hold benchmark passages go, and the rest is encoded and decoded again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmod.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from chatmod.llm.frames import table
from chatmod.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs).select(*docs.columns)


def drop_near_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return encoded.select(*docs.columns, "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_equal),
    ("simhash near-dedup", drop_near_equal),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]

# A learned score, SimHash and byte-pair encoding cannot be written in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, f"corpus-{uuid.uuid4().hex}")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
