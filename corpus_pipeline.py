"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages
can be run in one plan (``run``) or with every result written and read
again.  All but the last return the columns of ``documents``.

Defined cases, for every stage: a null text counts as empty, and empty
texts are clean of toxicity and of benchmarks, near copies of each other,
and of size 0 in the mixture; a null id or source is a value like any other
and, of near copies, a row with an id stays before one without; rows that
are repeated are judged one by one, but as near copies only one of them
stays; very long texts are read whole; an empty table, and empty labels or
benchmark, are allowed; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import decontam, mixing, sharding, simhash, toxicity
from corpusloom.session import cut


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(docs)
    return placed.select("doc.*", F.col("shard").alias("shard"), F.col("slot").alias("slot"))


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixture", mixture),
    ("shards", shards),
]

#: A trained kernel machine and connected components are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
