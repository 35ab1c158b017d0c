"""A corpus from raw documents to shards, in five stages of the operators in coursewright.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, what the stage before
has kept; all but the last return the columns of documents. Between stages ``run`` writes
Parquet to the shared folder and reads it again.

Defined results: a null or empty text, and one without a letter, has no language and goes in the
first stage. Ties of two languages go too. Of equal and near rows the one of least doc_id stays, of
rows without any id one of them; rows that repeat are such copies. A very long text stays whole in
all stages but the mixture, which may take a part of it. No rows: no rows. Columns beside those of
documents, of any name, are carried to the mixture's rows; shards have columns of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursewright.llm import decontaminate, langid, mixing, neardup, sharding
from coursewright.llm.common import documents, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or with a narrow margin go."""
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the target weights of their sources take."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.query(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Compression and sampling are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
