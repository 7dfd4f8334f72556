"""A corpus pipeline of the llm subpackage's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bagminhash, language, packing, pii, quality
from sparkloom.llm.common import crc_bucket, discard, scratch, shared_dir
from sparkloom.llm.queries import LEAST_QUALITY, table

#: A document whose nearest language profile is further away than this is in no language known.
LEAST_LANGUAGE = 0.15

#: The stages' results depend on models and on hashes that SQL lacks.
ORACLE_SQL: str | None = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of ``sf_dir``."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    return quality.keep_good(docs, weights, LEAST_QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language near one of the learned profiles."""
    return language.keep_known(docs, language.learn(docs, crc_bucket("doc_id", 4) != 2), LEAST_LANGUAGE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates; repeated rows are one."""
    return bagminhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and ``n_chars`` brought up to date."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and the sequences that they are."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next.

    What a stage wrote for itself goes when its result is written, and that when the next stage's is.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(docs)
        docs = spark.read.parquet(path)
        docs.sparkloom_path = path
    return docs
