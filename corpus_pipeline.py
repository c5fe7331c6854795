"""The corpus pipeline: each stage works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corbel.llm.jaccard import keep_representatives
from corbel.llm.leaks import decontaminate
from corbel.llm.packing import pack_documents
from corbel.llm.pii import redact_pii
from corbel.llm.quality import keep_good
from corbel.workspace import Workspace, closing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and those without words (null, empty or blank texts).

    The others come back unchanged with all their columns; repeated rows fare alike; no documents give none.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id.

    Of rows that repeat its id one stays; rows without an id and texts without words are in no group and stay.
    """
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly such passages (over half of its words) goes.

    Null and empty texts and all columns but text and n_chars come back unchanged; an empty benchmark cuts nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every row stays, null and empty texts unchanged.

    Without candidates in the corpus the classifier is fitted on its seed sentences alone.
    """
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts with their places in training sequences.

    A null or empty text is one piece of the closing id; repeated rows are packed each; no documents give no pieces.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("best-fit packing", packing)]

#: SQL expresses neither the trained stages nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with closing():
            docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
