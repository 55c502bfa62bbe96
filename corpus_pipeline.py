"""From raw documents to tokens in five stages; each reads what the one before it kept.

Quality rules drop documents, MinHash keeps one document of each near-duplicate group, decontamination drops documents with a
benchmark overlap, personal data is replaced by ``<KIND>``, and BPE gives token counts and digests of ids and decoded text.

Defined cases: null texts count as empty ones, which the quality rules reject; a null doc_id is kept through all stages; rows that repeat a doc_id
are one document for near duplicates, and one of them stays; an empty table gives an empty result; extra columns travel along up to the last stage, which
returns ``doc_id`` and the digests only. The stages' files stay in a folder of the run under the shared folder; who calls removes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratacat.llm import bpe_transducer, decontaminate, minhash, pii, quality_rules
from stratacat.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_transducer.encode(docs, public_tokenizers.path(bpe_transducer.MODEL))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("bpe", tokens),
]

#: Bucketed hashing, bootstrapping and BPE merges have no SQL form; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
