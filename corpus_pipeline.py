"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

quality_rules and quality_classifier drop what they reject, simhash keeps one document of each group of near
duplicates, decontamination drops documents that hold any window of benchmark text, sentencepiece encodes what is left. All but
the last return the columns of ``documents``, whatever their names, and whole texts of any length; an empty table
passes through all of them; the last returns doc_id, n_tokens, ids_sha256, decoded_sha256 and n_differ.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import byte_postings, common, phrase_index, piece_agenda, risk_rules, rule_ensemble


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and short texts go; rows of a null language are judged by the base rules, rows without a key like any other."""
    return risk_rules.keep_good(docs, common.table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row has a score, null and empty texts too; a score of exactly one half stays; without labels all rows stay."""
    return rule_ensemble.keep_good(docs, common.table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest key of each group stays, once; texts without words are one group; rows with a null key stay."""
    return byte_postings.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a key are judged each by its own text; null and empty texts stay, and all rows where there are no items."""
    return phrase_index.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, repeated ones and null keys too; null texts count as empty."""
    return piece_agenda.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Merges by score and a fitted classifier are not expressible in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
