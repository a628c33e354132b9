"""A corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. Repeated copies that the mix takes are repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import decontaminate, mixing, near_copies, quality_classifier, shards
from wakeline.llm.common import in_remainder, keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts; it learns from labels whose crc32 remainder is not held out.

    With no such label there is nothing to judge by, and all rows pass.
    """
    model = quality_classifier.fitted(docs, table(spark, sf_dir, "labels"), in_remainder("doc_id", 4, 2))
    return quality_classifier.accepted(docs, model) if len(model.labels) else docs


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more.

    Links come from SimHash and are checked; an exact search finds those that its blocks miss.
    """
    return near_copies.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and grown_shard."""
    return shards.assigned(docs)


STAGES = [("quality_classifier", quality), ("simhash_dedup", dedup), ("decontamination", clean), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
