"""Corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import common, lines, minhash, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; learnt from the labelled rows of the documents given."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first copy of each line only; those that consist of later copies go."""
    return lines.keep_first_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group linked by 0.75 of their five-word shingles."""
    return minhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, placed in sequences of 4096 tokens."""
    return packing.best_fit_packing(docs)


#: Stage names and functions (spark, docs, sf_dir); each works on what the one before it wrote.
STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("packing", pack)]

#: SQL can say neither of the first and last stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}-{uuid.uuid4().hex}")
    return STAGES[-1][1](spark, docs, sf_dir)
