"""The corpus pipeline: language, near duplicates, personal data, mixing of sources, packing.

Each stage takes what the one before has kept, and its decisions take effect. All but the last
return the columns of documents; the last returns token pieces with their places in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventmart.llm import language, mixing, near_dedup, packing, personal_data
from eventmart.llm.common import saved

#: Texts whose language is less sure than this are rejected; a guess between four scores 0.25.
LEAST_SCORE = 0.3
CAPACITY = 2048
#: Words a worker remembers while it encodes; the stages before have filled the executors' heaps.
REMEMBER = 250_000
#: Text a worker holds as words and ids at a time, for the same reason.
STRETCH = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language cannot be told."""
    return language.keep_known(docs, language.learn(docs), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id."""
    return near_dedup.distinct_documents(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return personal_data.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have equal weights, in shuffled order."""
    return mixing.mix(docs).drop("copy", "shuffle_key")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of at most CAPACITY."""
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, CAPACITY, REMEMBER, STRETCH)
    return packing.pack(parts, CAPACITY, free=True)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL cannot express the stages; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
