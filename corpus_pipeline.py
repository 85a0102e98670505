"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; each works on all rows that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkboard.llm.decontaminate import decontaminate
from sparkboard.llm.language_id import keep_identified
from sparkboard.llm.minhash_dedup import drop_near_duplicates
from sparkboard.llm.mixing import mix
from sparkboard.llm.sharding import shard_plan
from sparkboard.llm.shared import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is named with a score under one half."""
    return keep_identified(docs, least=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest doc_id."""
    return drop_near_duplicates(docs, threshold=0.8)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of ``benchmark`` out of the texts; a text of which nothing is left goes."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target, some more than once, some not at all."""
    return mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the final shards: doc_id, size, text_crc32, law, shard, slot."""
    return shard_plan(docs, shards=40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language ID and the shards have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
