"""From raw documents to packed token sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. The caller writes its result and reads it again for the next one; ``run``
does so in the shared folder, and deletes a stage's tables as soon as its result
is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import packing, quality, secrets, simhash
from tabwright.llm.common import discard, materialize, recording
from tabwright.storage import discard_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their hosts' verdicts keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.remove_secrets(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, window=2048)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("secrets", secret_scan), ("packing", pack_tokens)]

#: Similarity joins and the tokenizer are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of sf_dir; it reads the tables of that stage and the result before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with recording() as paths:
            result = stage(spark, docs, sf_dir)
        docs = materialize(result, f"pipeline-{name}")
        for path in paths:
            discard_path(spark, path)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
