"""The corpus pipeline: five stages over the documents, each written and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All stages but the last return the columns of
the documents: rejected documents go, and personal data is masked in the text.
The last returns how often each remaining document goes into the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import leaks, mixing, pii, simhash, toxicity
from tessera.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """1: documents whose score is 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """5: of each component of fingerprints, and of each group of near copies, the document with the smallest id stays; of repeated rows of one id, one."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: documents that hold a benchmark item go."""
    return leaks.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: personal data is masked; every document stays."""
    return pii.mask_pii(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """7: doc_id, source, size, source_size, target, taken, copies of every document."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("simhash_dedup", near_dedup), ("decontamination", decontaminate), ("pii", private), ("mixing", mixed)]

#: Trained models and similarity search have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


