"""The corpus pipeline: from raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pluvio.llm.common import documents, staged
from pluvio.llm.decontaminate import clean_documents
from pluvio.llm.near_dedup import first_of_each_group
from pluvio.llm.packing import pack
from pluvio.llm.quality_model import trusted_documents
from pluvio.llm.secrets import redacted
from pluvio.queries.base import Registry
from pluvio.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of the trusted text accepts."""
    ship_package(spark)
    return trusted_documents(docs, documents(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8."""
    ship_package(spark)
    return first_of_each_group(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return clean_documents(docs, documents(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts marked out; n_chars stays that of the raw text."""
    ship_package(spark)
    return redacted(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    ship_package(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: SQL states neither the language model nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None
REG = Registry()


@REG.add("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage but the last is written and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
