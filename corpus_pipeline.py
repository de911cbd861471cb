"""From raw documents to shards: five operators, each on all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from quarryline.llm.shared import Stored

#: learned models and alignment can't be said in SQL
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their places in the mixing schedule, mix_block, mix_slot and mix_place;
    none go."""
    return mixing.scheduled(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot with its id, size and checksum.  The slots
    of a shard follow the mixing schedule."""
    return sharding.kd_shards(docs, order=("mix_slot", "mix_place")).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir)).read()
    return STAGES[-1][1](spark, docs, sf_dir)
