"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, neardup, sharding, toxicity
from tidemark.llm.common import written
from tidemark.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones of docs, doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask for."""
    # Whole rows in a column of their own: whatever names they have, the mix adds and replaces none.
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    return mixing.mixed_documents(mixing.mix(rows, size="size", whole=True)).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 24 and their place in it, read from the shards as they were written."""
    return sharding.written_shards(sharding.shard_rows(docs, 24))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark-leaks", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learned scores, sampled signatures and seeded draws have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
