"""The corpus pipeline: documents are judged, deduplicated, decontaminated, masked and encoded.

Each stage takes all that its predecessor kept and is written as Parquet before the
next one reads it.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import bpe, decontaminate, pii, quality_rules, simhash
from docgauge.llm.common import shared_dir, table
from docgauge.llm.queries import vocabulary_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars is the new length."""
    return pii.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of each document."""
    return bpe.encode(docs, vocabulary_file())


STAGES = [("quality_rules", quality), ("simhash_dedup", dedup), ("decontaminate", clean), ("pii_mask", private), ("bpe_encode", encoded)]

#: The stages hash, embed and encode; they are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result lies in the shared folder, so a lost executor costs one stage at most."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
