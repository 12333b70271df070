"""A training corpus from the documents: five stages, each over all that the one before kept.

1. toxicity: documents that the counterfactual-regularised classifier rejects go.
2. near-duplicates: one document of each class stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: sources are replicated to their target weights.
5. sharding: every row of the mix gets a shard and a slot.

The first four return the columns of their input. A stage's result is written as Parquet in the shared folder before
the next one reads it. SQL cannot express the classifier, the sampling or the random walks, so there is no oracle; the
tests compare the pipeline with plain Python over a small corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import Scratch, table
from marlstone.llm.decontaminate import decontaminate_stage
from marlstone.llm.mixing import mix_stage
from marlstone.llm.neardup import neardup_stage
from marlstone.llm.sharding import shard_stage
from marlstone.llm.toxicity import toxicity_stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_stage(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup_stage(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate_stage(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_stage(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_stage(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
