"""From raw documents to a tokenised mixture: five stages, each over all rows that the one before it kept.

1. quality: documents that the ordinal classifier rejects go (op 8).
2. exact: of equal texts one document stays (op 5).
3. near: of each group of similar documents one stays (op 10).
4. mix: documents are repeated to the target weights of their sources (op 9); copies share their doc_id.
5. encode: byte-level BPE ids of every document, with digests of the ids and of the decoded text (op 4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, exact_dedup, ngram_join, poisson_mix, quality
from ledgerline.llm.tables import Tables, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mix.poisson_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [("quality", good), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The classifier's training and the tokenizer have no form in SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again by the next."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
