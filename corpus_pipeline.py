"""Cleaning a corpus in five stages; every stage reads what the one before it has written.

1. language ID: texts without a letter, or of which under half of the words have a known n-gram, go;
2. toxicity: texts predicted toxic go;
3. n-gram Jaccard join: of each group of near copies one document stays;
4. personal data: spans are masked in the text;
5. best-fit packing: one row per piece with its place in a sequence.

Stages 1 to 4 return the columns of `documents`. Null columns, empty texts, ties, repeated rows and empty
tables are treated as each operator documents; extra columns are carried through to stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard_join, language_id, packing, pii, toxicity
from tidemark.llm.common import table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copy_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers are outside SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
