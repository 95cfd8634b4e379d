"""The numbered queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    adaptive_scan,
    cover_dedup,
    language_id,
    license_scan,
    packing,
    quality_fm,
    quality_rules,
    residue_negatives,
    simhash,
    token_alignment,
    token_store,
    toxicity_crf,
    trie_bpe,
)
from barloom.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("clean_text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(spark, sf_dir)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_all(spark, sf_dir)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_crf.classify(spark, sf_dir)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read_back(table(spark, sf_dir, "documents"))


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.nearest(table(spark, sf_dir, "embeddings"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_negatives.mine(residue_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_best_fit_packing,
        op3_simhash_near_dedup,
        op4_license_scan,
        op5_quality_classifier,
        op6_language_id,
        op7_toxicity,
        op8_token_store,
        op9_trie_bpe,
        op10_nearest_neighbours,
        op11_cross_tokenizer,
        op12_hard_negatives,
        op13_substring_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.sql(),
    "op4_license_scan": license_scan.sql(),
    "op12_hard_negatives": residue_negatives.sql(),
}
