"""The corpus pipeline: five stages over ``documents``, each one of the numbered operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet to the shared checkpoint folder and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from velocis.llm import byte_bpe, digest_merge, pareto_mix, simhash_trie, weak_quality
from velocis.llm.common import materialise
from velocis.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier rejects go."""
    return weak_quality.keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of texts that are equal without white space, one row stays."""
    return digest_merge.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of linked fingerprints stays, the smallest id."""
    return simhash_trie.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix of sources takes it."""
    return pareto_mix.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids (little-endian unsigned 32-bit integers) of each document, checked by decoding."""
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                 public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The quality classifier and byte-pair merges cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
