"""A training-corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return docs' columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bathyal.llm.common import passing, remove, shared_folder
from bathyal.llm.exact_dedup import keep_one_of_each
from bathyal.llm.language import keep_known_language
from bathyal.llm.minhash import keep_one_of_group
from bathyal.llm.mixing import mix
from bathyal.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: without a letter, or with n-grams unlike those of every language."""
    return keep_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return keep_one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: shingles of five words, similarity 0.8."""
    return keep_one_of_group(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources meet their targets; a document taken twice is there twice."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into windows of 2048 tokens."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Character profiles, components and token ids can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. Each stage's output is written and read again; it goes when the next one is
    written, the last one's input when the session's file system closes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    passing(spark, folder)
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
