"""A corpus pipeline over `documents`: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. The first three return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import near_copies, packing, quality_fm, toxicity_crf
from barloom.llm.common import CACHE_ENTRIES, shared_dir, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of the whole table."""
    small_batches(spark)
    machine = quality_fm.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_fm.keep(docs, machine)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit. It learns from the labelled rows of the whole table."""
    small_batches(spark)
    chain = toxicity_crf.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity_crf.keep(docs, chain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Covering SimHash tables and MinHash buckets give the candidates, whole shingle sets are compared.
    """
    small_batches(spark)
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, entries=CACHE_ENTRIES)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", pack)]

ORACLE_SQL = None  # trained scores and a tokenizer are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
