"""From raw documents to shards of a training corpus: five stages, each one operator over all its predecessor kept.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each group of near copies the document with the smallest id stays.
3. decontaminate: documents that hold a benchmark window go.
4. mix: every document is taken as often as its source's target weight asks for, maybe never.
5. shard: every row gets its shard from the virtual slot map.

Nulls: a null text has no words, so the quality rules reject it; a null id or source is kept as any other, and copies without an id go
as others do. Repeated rows (same id, same text) leave one. Ties of equal ids go to the text with the smallest hash. Empty tables,
documents or benchmark, give an empty result or clean documents. Further columns pass through under their own names, whatever
these are; the last stage adds shard, virtual_slot and map_version and replaces columns of these names.

Every stage but the last returns the columns of documents. A stage's result is written before the next one begins, so each
stage first deletes the scratch tables of the one before it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import decontam, mixing, neardup, quality, sharding
from cairnflow.llm.common import materialise, own_scratch, read_table, release


def _stage(work):
    """A stage that deletes the scratch tables of the stage before it and owns those it writes."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "stage")
        own_scratch("stage")
        try:
            return work(spark, docs, sf_dir)
        finally:
            own_scratch("")

    return run_stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


@_stage
def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shard(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", assign_shards),
]

#: Perplexity and min-max hashing can't be written in SQL; tests/llm/test_corpus.py holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        own_scratch(f"out-{name}")
        try:
            docs = materialise(out, name)
        finally:
            own_scratch("")
        if before:  # this stage's rows are written, so those it was made of can go
            release(spark, before)
        before = f"out-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
