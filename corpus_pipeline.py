"""Corpus pipeline: five stages over ``documents``, each on all that the stage
before it kept, written as Parquet in between.

1. language_id: documents without a language (null, or no letter) go.
2. simhash_dedup: of each component of near copies the document with the
   smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. secret_scan: found secrets are replaced by their kind; all documents stay.
5. sentencepiece: the tokens of every document that is left, as digests.

Null ids, repeated rows, empty texts and empty tables are handled as the
operators state; additional columns of documents are carried through the first
four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casebook.llm import decontaminate, language, secrets, sentencepiece_codec, simhash
from casebook.llm.common import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unknown(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs, "text", "n_chars")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.digest_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: Fingerprints, edit-tolerant search and the tokenizer have no SQL form; the
#: tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
