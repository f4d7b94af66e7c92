"""A training corpus from ``documents``: filter, deduplicate, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Columns of any name are carried
along; null ids and texts, empty texts and repeated rows are treated as each operator states; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideflow.llm import decontaminate, line_crf, mixing, near_dup, sharding
from strideflow.llm.common import new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return line_crf.good_documents(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id. Rows of equal doc_id and text are one document; null ids come last."""
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, with or without a doc_id."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and place in it."""
    return sharding.shard(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]
#: Learned weights and similarity joins have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
