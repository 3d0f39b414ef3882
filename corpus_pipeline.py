"""From raw documents to token ids: language, near-duplicates, repeated passages, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next
stage's docs. All but the last return the columns of documents, and any other columns that docs has, whatever their
names. Null and empty texts go with the first stage; the later ones keep them if they are given some. Rows are told by
doc_id and text, null ids too, so a row never goes for another's sake; of rows that repeat the second stage keeps one.
Empty tables give empty tables. Texts may be of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language, pieces, simhash, suffix_dedup
from tessera.llm.common import drop, kept_until_exit, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, with it where lang is null; those without a letter go."""
    return language.with_language(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of smallest doc_id, null last."""
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 100 that start earlier."""
    return suffix_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return pieces.tokenize(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Automata, fingerprints, suffix arrays and merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each table between two stages is dropped when the next one is written; the last goes with the application."""
    docs = table(spark, sf_dir, "documents")
    at, made = kept_until_exit(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if made is not None:
            drop(made)
        docs = made = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
