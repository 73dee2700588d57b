"""From raw documents to packed training sequences in five stages.

Every stage takes what the one before kept, as written to and read back from the shared folder. All but the last
return the columns of ``documents``:

1. ``language_id`` drops documents whose language cannot be told: texts that are null or without a letter.
2. ``near_dedup`` keeps one document of every group of SimHash near duplicates, that with the smallest id.
3. ``decontamination`` drops documents that hold a benchmark item.
4. ``pii`` replaces personal data in the texts by its kind.
5. ``packing`` gives the pieces of the documents and their places in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reachlens.llm import decontaminate, language, packing, pii, simhash
from reachlens.llm.queries import prepare, table, tokenizer_file
from reachlens.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, packing.Packing(tokenizer_file()))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]

#: Language models, fingerprints and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
