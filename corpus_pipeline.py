"""The corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents` (and perhaps more, which it keeps), and
works on all rows that the stage before kept. All but the last return the columns of docs. What a stage makes of nulls,
empty or repeated rows is said by the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontam, exact, langid, neardup, packing
from loomline.scratch import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter go."""
    return langid.accepted(docs, langid.trained(docs, F.lit(True)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest doc_id."""
    return exact.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar sets of five-word shingles the document of the smallest doc_id."""
    return neardup.dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("pack", pack)]
#: The language model and the tokeniser are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
