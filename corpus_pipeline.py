"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, shards.

Each stage works on all that the stage before it kept, and is written to the
shared folder before the next one reads it; what a stage wrote besides is removed
once its result is there. Columns beyond those of documents pass through all
stages (the last appends "_in" to those that have names of its own); rows of null
texts or of none with a letter go with the first stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import langid_crf, prefix_join, probminhash, virtual_slots, waterfill
from sluice.llm.common import cut, release, scratch

SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: all but null texts and texts without a letter."""
    return langid_crf.keep_known(docs, langid_crf.train(langid_crf.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return probminhash.keep_one(docs, probminhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than a twentieth of benchmark windows."""
    return prefix_join.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return waterfill.mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, whole, beside its shard, virtual slot and position in the shard."""
    return virtual_slots.shard_documents(docs, SHARDS, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No SQL states trained labels or components by signatures; tests/llm compares every stage's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch(spark, kept):
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Run all stages and write the shards, one folder each."""
    virtual_slots.write_shards(run(spark, sf_dir), path)
