"""A training-data pipeline over ``documents``: STAGES in order, each on all that
its predecessor kept.

1. language_id: documents without letters, or in none of the learned languages, go.
2. ngram_join: one document of each group of near copies stays.
3. decontaminate: documents that contain a benchmark item go.
4. mix: whole documents, each as often as the mix takes at least half its words
   (up to twice), so that the sources come near their target weights, in the order
   of the mix's schedule.
5. shard: the rows as they stand in the compacted store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.llm import decontaminate, language_id, mixing, ngram_join, sharding
from brevis.llm.common import cut, discard, scratch, shared_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_stage(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_join", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Shard names follow from the sizes of written files, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, folder = docs, shared_dir(spark)
        with scratch(spark):
            docs = cut(stage(spark, before, sf_dir), name, folder)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
