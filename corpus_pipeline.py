"""The corpus pipeline: documents through five of the llm operators, each stage written and read by the next.

A stage's rows keep the columns of documents, extra ones and ones with clashing names included; the last adds where each
kept document goes. SQL can't express the stages; the tests compare them with brute force.

Defined results: null and empty texts, and texts without a letter, have no language and go in the first stage; so do texts
whose best language has a score under a half. Rows that repeat, with or without an id, are copies of each other, of which one
stays; among near copies the one with the smallest id stays. Very long texts are worked on whole in every stage. Ties of
size go to the lower shard. An empty table gives no rows, and a table without a token is mixed as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, langid, mixing, sharding, simhash

SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language is found; learned from the labels of a bounded sample of them."""
    return langid.known(docs, langid.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of copies and near copies (five-word shingles, similarity 0.8).

    Links of SimHash fingerprints, and bands of minima for what lies beyond their distance (README); each pair is verified exactly."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: benchmark passages are cut out; documents that consist of them for over a half go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents drawn with probabilities raked to source, language and topic shares."""
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the shard and slot of each document."""
    return sharding.assign(docs, SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each but the last through a table in the shared folder."""
    docs, where = common.documents(spark, sf_dir), common.shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"{where}/{i}-{name}")
    return docs
