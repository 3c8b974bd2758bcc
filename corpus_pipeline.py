"""A training corpus in five stages: toxic documents go, one of each group of near-duplicates stays, documents that
hold benchmark items go, secrets are masked, and what is left is tokenized and packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm.common import drop, table, written
from lanewise.llm.decontam import without_leaks
from lanewise.llm.minhash import without_near_duplicates
from lanewise.llm.packing import pack_documents
from lanewise.llm.secrets import without_secrets
from lanewise.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; null and empty texts are scored like texts without a known word, repeated rows each by themselves."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the rows of the smallest doc_id; rows without an id or without words stay."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found; without items all of them, and all rows without a text."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; a null text stays null."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids, a null text as an empty one; an empty table gives none."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: The stages learn a classifier, project into a latent space and run a tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)  # nothing reads a stage's table any more; the input tables are left alone
    return docs
